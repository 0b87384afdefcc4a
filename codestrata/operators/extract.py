"""Definitions, imports, calls and routes from source text, as window jobs over the lines of files.

Files are placed once by (repository_id, path). Their lines, the bracket depth or indentation of every line, the
matching of a definition to its last line, and the join back to the text all use that placement: one shuffle of text.
A lexer tells code from strings, comments and regular expressions, and cuts a line where a definition begins inside it.
Rules are data: a pattern gives the kind and the name of the definition that starts on such a piece. Block ends come from
bracket depth (JavaScript, TypeScript, Java, Go) or indentation (Python). The result is approximate by design: a syntax tree
would know more of what a rule can only guess.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from codestrata.functions import constants as C
from codestrata.functions.lexer import file_code, file_pieces
from codestrata.functions.paths import route_of_file
from codestrata.functions.routes import CONTROLLER_PREFIX, REQUEST_MAPPING_PREFIX, decorator_route, router_prefixes
from codestrata.functions.text import call_names, clip, header_of, lines_of

from .ranking import place

FILE = ["repository_id", "path"]
JS, PY, JAVA, GO = ("TypeScript", "JavaScript"), ("Python",), ("Java",), ("Go",)
PARSED = JS + PY + JAVA + GO

EXPORT = r"^(?:export\s+(?:default\s+)?)?(?:declare\s+)?"
JAVA_MODIFIERS = r"(?:(?:public|protected|private|static|final|abstract|sealed|non-sealed|strictfp|synchronized|native|default)\s+)*"
JS_MODIFIERS = r"(?:(?:public|private|protected|static|async|get|set|readonly|override|abstract)\s+|\*\s*)*"
ARROW = r"(?:async\s*)?(?:function\b|\([^()]*\)\s*(?::[^=]+)?=>|[A-Za-z_$][\w$]*\s*=>|(?:<[^>]*>)?\((?:[^()]|\([^()]*\))*$|(?:<[^>]*>)?\((?:[^()]|\([^()]*\))*\)\s*(?::[^=]+)?=>)"
KEYWORDS = r"(?!(?:if|for|while|switch|catch|return|function|new|throw|else|do|try|case|default|super|import|export|const|let|var|await|typeof|delete|yield)\b)"

# (languages, kind, place, end rule, name group, pattern). Place: 'top' = depth 0, 'member' = body of a class,
# 'type' = depth 0 or body of a class, 'any' = anywhere a class or file allows. End rule: 'block' or 'statement'.
RULES = (
    (JS, "function", "top", "block", 1, EXPORT + r"(?:async\s+)?function\s*\*?\s*([A-Za-z_$][\w$]*)?"),
    (JS, "class", "top", "block", 1, EXPORT + r"(?:abstract\s+)?class\b(?:\s+(?!extends\b)([A-Za-z_$][\w$]*))?"),
    (JS, "interface", "top", "block", 1, EXPORT + r"interface\s+([A-Za-z_$][\w$]*)"),
    (JS, "type", "top", "statement", 1, EXPORT + r"type\s+([A-Za-z_$][\w$]*)\s*(?:<[^=]*>)?\s*="),
    (JS, "enum", "top", "block", 1, EXPORT + r"(?:const\s+)?enum\s+([A-Za-z_$][\w$]*)"),
    (JS, "arrow", "top", "statement", 1, r"^(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?::[^=]+(?:=>[^=]+)?)?=\s*" + ARROW),
    (JS, "class", "top", "statement", 1, r"^(?:export\s+)?(?:const|let|var)\s+[\w$]+\s*=\s*class\b(?:\s+(?!extends\b)([A-Za-z_$][\w$]*))?"),
    (JS, "call", "top", "statement", 1, r"^(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?::[^=]+)?=\s*(?:await\s+)?([A-Za-z_$][\w$.]*)(?:<[^(]*>)?[(`]"),
    (JS, "assigned", "top", "statement", 1, r"^[A-Za-z_$][\w$.]*\.([A-Za-z_$][\w$]*)\s*=\s*" + ARROW),
    (JS, "default", "top", "statement", 1, r"^export\s+default\s+(?:async\s*)?(?:\([^()]*\)|[A-Za-z_$][\w$]*)\s*=>()"),
    (JS, "method", "member", "block", 1, r"^\s*" + JS_MODIFIERS + KEYWORDS + r"([A-Za-z_$#][\w$]*)\s*(?:<[^>]*>)?\s*\((?!.*;\s*$)"),
    (JS, "field", "member", "statement", 1, r"^\s*" + JS_MODIFIERS + r"([A-Za-z_$#][\w$]*)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^()]*\)|[A-Za-z_$][\w$]*)\s*(?::[^=]+)?=>"),
    (PY, "function", "any", "block", 1, r"^\s*(?:async\s+)?def\s+(\w+)"),
    (PY, "class", "any", "block", 1, r"^\s*class\s+(\w+)"),
    (JAVA, "interface", "type", "block", 1, r"^\s*(?:@\w+(?:\([^)]*\))?\s+)*" + JAVA_MODIFIERS + r"interface\s+(\w+)"),
    (JAVA, "enum", "type", "block", 1, r"^\s*(?:@\w+(?:\([^)]*\))?\s+)*" + JAVA_MODIFIERS + r"enum\s+(\w+)"),
    (JAVA, "class", "type", "block", 1, r"^\s*(?:@\w+(?:\([^)]*\))?\s+)*" + JAVA_MODIFIERS + r"(?:class|record)\s+(\w+)"),
    (JAVA, "method", "member", "block", 1, r"^\s*(?:@\w+(?:\([^)]*\))?\s+)*" + JAVA_MODIFIERS + r"(?:<[^>]+>\s+)?(?!(?:return|new|else|throw)\b)[\w<>\[\],.? ]+?\s+(\w+)\s*\("),
    (JAVA, "method", "member", "block", 1, r"^\s*(?:(?:public|protected|private)\s+)?([A-Z]\w*)\s*\([^;]*$"),
    (GO, "function", "top", "block", 1, r"^func\s+(\w+)"),
    (GO, "method", "top", "block", 2, r"^func\s+\(\s*(?:\w+\s+)?\*?\s*(\w+)[^)]*\)\s*(\w+)"),
    (GO, "group", "top", "statement", 1, r"^type\s*\(()"),
    (GO, "struct", "top", "block", 1, r"^type\s+(\w+)(?:\[[^\]]*\])?\s+struct\b"),
    (GO, "interface", "top", "block", 1, r"^type\s+(\w+)(?:\[[^\]]*\])?\s+interface\b"),
    (GO, "type", "top", "statement", 1, r"^type\s+(\w+)(?:\[[^\]]*\])?\s*=?\s*[^\s(]"),
    (GO, "struct", "grouped", "block", 1, r"^\s+(\w+)(?:\[[^\]]*\])?\s+struct\b"),
    (GO, "interface", "grouped", "block", 1, r"^\s+(\w+)(?:\[[^\]]*\])?\s+interface\b"),
    (GO, "type", "grouped", "statement", 1, r"^\s+(\w+)(?:\[[^\]]*\])?\s*=?\s*[\w*\[.]+"),
)

# Receivers and verbs of call-style routes.
JS_ROUTE = (
    r"(?:^|[^\w.$])(?:app|router|server|api|r|route|routes|fastify|\w*[Rr]outer|\w*[Aa]pp)\."
    r"(get|post|put|patch|delete|all|options|head)\(\s*['\"`](/[^'\"`]*)['\"`]"
)
GO_ROUTE = r"\.(HandleFunc|Handle|GET|POST|PUT|PATCH|DELETE|Get|Post|Put|Patch|Delete|Any)\(\s*[\"`](/[^\"`]*)[\"`]"
JSX = r"(?m)(?:^|return|[(=>&|?:,{])\s*<(?:[A-Za-z][\w.]*(?:\s|/?>)|>)"


def _count(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def scanned_lines(files: DataFrame) -> DataFrame:
    """Pieces of files with what the block rules need: depth before and after, indentation, code, decorator runs.

    files(repository_id, path, language, pieces) must already be placed by (repository_id, path).  A piece is a line, or a
    part of one; `n` numbers the pieces of a file.
    """
    order = Window.partitionBy(*FILE).orderBy("n")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    is_py, c = F.col("language").isin(*PY), F.col
    # A plain explode would make the optimizer look at the number of pieces first, and scan every file once more for it.
    lines = files.select(*FILE, "language", F.posexplode_outer("pieces").alias("i", "piece")).select(
        *FILE, "language", (c("i") + 1).alias("n"), F.regexp_replace("piece.line", r"\s+$", "").alias("line"), "piece.code", "piece.in_text")
    delta = _count(c("code"), r"[({\[]") - _count(c("code"), r"[)}\]]")
    depth = F.coalesce(F.sum(delta).over(before), F.lit(0))
    lines = lines.withColumns({"depth": depth, "after": depth + delta})

    has_code = F.trim("code") != ""
    logical = ~c("in_text") & has_code & F.when(is_py, c("depth") == 0).otherwise(True)
    indent = F.length(F.regexp_extract("line", r"^(\s*)", 1))
    names_type = c("code").rlike(r"\b(class|interface|enum|record|void)\b|\{\s*$")
    decorator = logical & F.ltrim("line").startswith("@") & ~F.ltrim("line").startswith("@interface") & (is_py | ~names_type)
    lines = lines.withColumns({
        "logical": logical, "level": F.when(is_py, indent).otherwise(c("depth")), "decorator": decorator,
        "content_n": F.when((c("line") != "") & (c("in_text") | has_code), c("n")),
    })
    if_logical = lambda column: F.when(c("logical"), column)
    prev_decorator = F.coalesce(F.last(if_logical(c("decorator")), True).over(before), F.lit(False))
    lines = lines.withColumns({
        "prev_level": F.last(if_logical(c("level")), True).over(before),
        "prev_content": F.last("content_n", True).over(before),
        "prev_decorator": prev_decorator,
        "next_level": F.expr("lead(if(logical, level, null)) ignore nulls over (partition by repository_id, path order by n)"),
        "next_line": F.lead(F.ltrim("code")).over(order),
        "last_content": F.max("content_n").over(Window.partitionBy(*FILE)),
    })
    run_start = F.last(F.when(c("decorator") & ~c("prev_decorator"), c("n")), True).over(before)
    return lines.withColumn("start", F.when(c("prev_decorator"), run_start).otherwise(c("n")))


def _matched() -> Column:
    """Definitions that may start on a line, first rule first, plus a call-style route."""
    language, line, depth = F.col("language"), F.col("line"), F.col("depth")
    found = []
    for languages, kind, place, rule, group, pattern in RULES:
        fits = {"top": depth == 0, "member": depth > 0, "grouped": depth == 1}.get(place, F.lit(True))
        parent = F.regexp_extract(line, pattern, 1) if group == 2 else F.lit(None).cast("string")
        called = F.regexp_extract(line, pattern, 2) if kind == "call" else F.lit(None).cast("string")
        found.append(F.when(
            language.isin(*languages) & F.col("logical") & fits & line.rlike(pattern),
            F.struct(F.lit(kind).alias("kind"), F.lit(place).alias("place"), F.lit(rule).alias("rule"),
                     F.regexp_extract(line, pattern, group).alias("name"), parent.alias("receiver"), called.alias("called")),
        ))
    none = F.lit(None).cast("string")
    route = lambda pattern, name: F.struct(F.lit("route").alias("kind"), F.lit("route").alias("place"), F.lit("statement").alias("rule"),
                                           name.alias("name"), F.regexp_extract(line, pattern, 1).alias("receiver"), none.alias("called"))
    go_verb = F.when(F.regexp_extract(line, GO_ROUTE, 1).startswith("Handle"), "ANY").otherwise(F.upper(F.regexp_extract(line, GO_ROUTE, 1)))
    js = F.when(language.isin(*JS) & F.col("logical") & line.rlike(JS_ROUTE),
                route(JS_ROUTE, F.concat_ws(" ", F.upper(F.regexp_extract(line, JS_ROUTE, 1)), F.regexp_extract(line, JS_ROUTE, 2))))
    go = F.when(language.isin(*GO) & F.col("logical") & line.rlike(GO_ROUTE), route(GO_ROUTE, F.concat_ws(" ", go_verb, F.regexp_extract(line, GO_ROUTE, 2))))
    return F.array_compact(F.array(F.coalesce(*found), F.coalesce(js, go)))


def definition_ranges(lines: DataFrame) -> DataFrame:
    """Definitions with first line, last line and owner, from scanned lines."""
    is_py = F.col("language").isin(*PY)
    code, depth, after = F.col("code"), F.col("depth"), F.col("after")
    ends_block = F.contains(code, F.lit("}")) | F.rtrim(code).endswith(";")
    goes_on = F.rtrim(code).rlike(r"(=>|=|,|\||&|\+|\?|:|\()$") | F.coalesce(F.col("next_line").rlike(r"^([|.?:&]|=>)"), F.lit(False))
    # A line closes every level between its depth after and before; in Python a logical line closes all deeper levels.
    closes = F.when(is_py, F.col("logical") & (F.col("level") <= F.col("prev_level"))).otherwise((F.trim(code) != "") & (after <= depth))
    low = F.when(is_py, F.col("level")).otherwise(after)
    high = F.when(is_py, F.col("prev_level")).otherwise(depth)
    end = F.when(is_py, F.col("prev_content")).otherwise(F.col("n"))
    none = F.lit(None).cast("int")
    definition_type = "struct<kind:string,place:string,rule:string,name:string,receiver:string,called:string>"
    closing = F.transform(
        F.when(closes, F.sequence(low.cast("int"), high.cast("int"))).otherwise(F.array().cast("array<int>")),
        lambda level: F.struct(
            level.alias("lvl"), F.when(is_py, F.col("n") * 4 - 1).otherwise(F.col("n") * 4 + 1).alias("key"),
            F.when(is_py | ends_block, end).alias("block_end"), F.when(is_py | ~goes_on, end).alias("statement_end"),
            F.lit(None).cast(definition_type).alias("d"),
        ),
    )
    starting = F.transform(_matched(), lambda d: F.struct(
        F.col("level").cast("int").alias("lvl"), (F.col("n") * 4).alias("key"), none.alias("block_end"), none.alias("statement_end"), d.alias("d")))
    marks = lines.select(
        *FILE, "language", "n", "start", "level", "next_level", "last_content", F.explode(F.concat(starting, closing)).alias("m")
    ).select(*FILE, "language", "n", "start", "level", "next_level", "last_content", "m.*")
    following = Window.partitionBy(*FILE, "lvl").orderBy(F.desc("key")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ended = marks.withColumn("_block", F.min("block_end").over(following)).withColumn("_statement", F.min("statement_end").over(following))
    found = ended.where(F.col("d").isNotNull()).withColumn(
        "end", F.coalesce(F.when(F.col("d.rule") == "block", F.col("_block")).otherwise(F.col("_statement")), F.col("last_content"))
    ).withColumn("end", F.greatest("end", "n"))

    # Owners: a class opens the level of its body; a member belongs to the last class that opened its level.
    opens = F.col("d.kind").isin("class", "interface", "enum", "group", "struct")
    body = F.when(is_py, F.coalesce("next_level", F.lit(-1))).otherwise(F.col("level") + 1)
    own = F.struct(F.col("level").cast("int").alias("at"), F.lit(False).alias("scope"))
    rows = found.select("*", F.explode(F.when(opens, F.array(own, F.struct(body.cast("int").alias("at"), F.lit(True).alias("scope"))))
                                       .otherwise(F.array(own))).alias("o"))
    earlier = Window.partitionBy(*FILE, "o.at").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    scope = F.struct(F.col("d.name").alias("name"), F.col("d.kind").alias("kind"), F.col("n").alias("n"), F.col("start").alias("start"),
                     F.col("end").alias("end"))
    owned = rows.withColumn("owner", F.last(F.when(F.col("o.scope"), scope), True).over(earlier)).where(~F.col("o.scope"))
    owner = F.when(F.col("owner.end") >= F.col("n"), F.col("owner"))
    owned = owned.withColumn("owner", owner)
    place, level = F.col("d.place"), F.col("level")
    in_class = F.col("owner.kind").isin("class", "interface", "enum")
    allowed = (
        F.when(place.isin("top", "route"), True).when(place == "grouped", F.col("owner.kind") == "group")
        .when(place == "member", in_class).otherwise((level == 0) | in_class)
    )
    return owned.where(F.coalesce(allowed, F.lit(False)) & (F.col("d.kind") != "group")).select(
        *FILE, "n", "start", "end", F.col("d.kind").alias("kind"), F.col("d.place").alias("place"), F.col("d.name").alias("name"),
        F.col("d.receiver").alias("receiver"), F.col("d.called").alias("called"),
        F.when(place != "grouped", F.col("owner.name")).alias("owner"),
        F.when(place != "grouped", F.col("owner.n")).alias("owner_n"), F.when(place != "grouped", F.col("owner.start")).alias("owner_start"),
    )


def _call_text(name: Column, language: Column, code: Column) -> Column:
    """The code behind a definition's own name, without the names of functions defined in it."""
    at = F.instr(code, name)
    body = F.when(at > 0, F.substring(code, at + F.length(name), F.length(code))).otherwise(code)
    own = F.when(language.isin(*PY), F.regexp_replace(body, r"\bdef\s+\w+", "''")).otherwise(F.regexp_replace(body, r"\bfunction\s*\*?\s*\w*", "''"))
    # Type arguments stand between a name and its parenthesis in scripts.
    return F.when(language.isin(*JS), F.regexp_replace(own, r"([A-Za-z_$][\w$]*)<[\w$\s,.|\[\]<>]+>(?=\()", "$1")).otherwise(own)


HEADS = {  # definitions, whose names stand before a parenthesis without being called
    "Python": r"\b(?:def|class)\s+\w+", "Go": r"\bfunc\s*(?:\([^)]*\)\s*)?\w*",
    "Java": r"(?m)^\s*(?:@\w+(?:\([^)]*\))?\s*)*(?:(?:public|protected|private|static|final|abstract|synchronized|native|default)\s+)+(?:<[^>]*>\s*)?(?:[\w.<>\[\],? ]+\s)?\w+\s*(?=\()",
    "": r"\bfunction\s*\*?\s*\w*|(?m)^\s*(?:(?:public|private|protected|static|async|get|set|readonly|override)\s+)*(?!if\b|for\b|while\b|switch\b|catch\b|return\b)[A-Za-z_$][\w$]*\s*(?=\([^()]*\)\s*(?::[^{;=]*)?\{)",
}


def loose_calls(content: Column, language: Column) -> Column:
    """Names called in a whole file: strings, comments, and the names of definitions are left out."""
    bare = _call_text(F.lit("\0"), language, file_code(content, language))
    text = F.regexp_replace(bare, HEADS[""], "''")
    for name in ("Python", "Java", "Go"):
        text = F.when(language == name, F.regexp_replace(bare, HEADS[name], "''")).otherwise(text)
    return call_names(text, None, language)


def extract_entities(files: DataFrame, clipped: bool = False, max_calls: int | None = None) -> DataFrame:
    """Staging entities of parsed languages: schema of `code_entities` without id, module and embedding, plus calls and handler.

    files(repository_id, path, language, content); other languages are passed over. `clipped` cuts the stored text of an
    entity to the lines a small index keeps, `max_calls` its call names.
    """
    placed = place(files.where(F.col("language").isin(*PARSED)).select(*FILE, "language", "content"), *FILE).withColumn(
        "pieces", file_pieces(F.col("content"), F.col("language")))
    found = definition_ranges(scanned_lines(placed))
    # A file's definitions meet its text once; both sides are placed by file already, and neither is to be broadcast.
    listed = found.groupBy(*FILE).agg(F.collect_list(F.struct("n", "start", "end", "kind", "place", "name", "receiver", "called", "owner",
                                                             "owner_n", "owner_start")).alias("defs"))
    rows = placed.join(listed.hint("merge"), FILE).select(*FILE, "language", "content", "pieces", lines_of(F.col("content")).alias("lines"),
                                            F.explode("defs").alias("d")).select(*FILE, "language", "content", "pieces", "lines", "d.*")
    c = F.col
    # Definitions are ranges of pieces; from here on they are ranges of lines, but for the code, which is that of the pieces.
    line_at = lambda piece: F.get("pieces", c(piece) - 1)["n"]
    code = F.array_join(F.transform(F.slice("pieces", c("n"), c("end") - c("n") + 1), lambda p: p["code"]), "\n")
    rows = rows.select("*", F.inline(F.array(F.struct(code.alias("code"), F.get("pieces", c("n") - 1)["line"].alias("first_line"))))).withColumns(
        {name: line_at(name) for name in ("n", "start", "end", "owner_n", "owner_start")}).drop("pieces")
    lang, kind, lines = c("language"), c("kind"), c("lines")
    is_js, is_py, is_java, is_go = (lang.isin(*g) for g in (JS, PY, JAVA, GO))

    # JavaScript ranges begin at the decorators only for classes; Go has none.
    start = F.when(is_py | is_java | (is_js & (kind == "class")), c("start")).otherwise(c("n"))
    owner_at = F.when(is_js, c("owner_n")).otherwise(c("owner_start"))
    header = header_of(lines, F.when(is_js, c("n")).otherwise(start), F.when(is_js, 1).when(is_py, 3).otherwise(4))
    # An inlined struct is computed once per row; filters on what follows are not pushed below it.
    computed = F.struct(
        start.alias("first"), clip(lines, start, c("end")).alias("body"), header.alias("header"),
        header_of(lines, start, F.lit(3)).alias("type_header"),
        F.when(c("owner").isNotNull(), header_of(lines, owner_at, F.when(is_js, 2).otherwise(3))).alias("owner_header"),
    )
    rows = rows.select("*", F.inline(F.array(computed)))
    first_line = c("first_line")

    has_jsx = ~c("path").rlike(r"(?i)\.(ts|mts|cts)$") & c("name").rlike("^[A-Z]") & c("body").rlike(JSX)
    makes_function = F.contains(c("body"), F.lit("=>")) | c("body").rlike(r"\bfunction\b")
    js_type = (
        F.when(kind.isin("function", "arrow") & has_jsx, "component").when(kind.isin("function", "arrow", "assigned", "default"), "function")
        .when(kind == "field", "method")
        .when((kind == "call") & c("called").rlike(C.MODEL_CALL), "model")
        .when((kind == "call") & c("name").rlike("^[A-Z]") & c("called").rlike(C.COMPONENT_CALL), "component")
        .when((kind == "call") & makes_function & (c("end") - c("n") > 3), "function")
        .when(kind != "call", kind)
    )
    py_bases = F.regexp_extract(c("body"), r"(?m)^\s*class\s+\w+\s*(\([^)]*\))", 1)
    py_type = (
        F.when((kind == "function") & c("owner").isNotNull(), "method").when((kind == "class") & py_bases.rlike(C.PYTHON_MODEL_BASES), "model").otherwise(kind)
    )
    java_type = F.when((kind == "class") & c("type_header").rlike(C.JAVA_MODEL), "model").otherwise(kind)
    go_type = F.when(kind == "struct", "class").otherwise(kind)
    symbol_type = F.when(is_js, js_type).when(is_py, py_type).when(is_java, java_type).otherwise(go_type)

    # An arrow rule that matched an open parenthesis must turn out to hold an arrow.
    real = (~kind.isin("arrow", "assigned")) | makes_function
    name = F.when(c("name") != "", c("name")).when(is_js & (kind == "class"), "AnonymousClass").otherwise("default")
    rows = rows.withColumns({"symbol_type": symbol_type, "symbol_name": name}).where(c("symbol_type").isNotNull() & real)

    symbol = c("symbol_type")
    parent = F.when(is_go & (kind == "method"), c("receiver")).when((kind != "route") & ~is_go & ~(is_py & (kind == "class")), c("owner"))
    exported = (
        F.when(kind == "route", False)
        .when(is_js, F.when(kind.isin("method", "field"), F.coalesce(c("owner_header"), F.lit("")).rlike(r"(?m)^export\b")).otherwise(
            first_line.rlike(r"^export\b") | (kind == "assigned")))
        .when(is_py, ~c("name").startswith("_")).when(is_java, F.when(kind == "method", c("header")).otherwise(c("type_header")).rlike(r"\bpublic\b"))
        .otherwise(c("name").rlike("^[A-Z]"))
    )
    class_path = F.when(is_js, F.regexp_extract(F.coalesce("owner_header", F.lit("")), CONTROLLER_PREFIX, 1)).otherwise(
        F.regexp_extract(F.coalesce("owner_header", F.lit("")), REQUEST_MAPPING_PREFIX, 1))
    decorated = (
        F.when(is_py & (kind == "function"), decorator_route(c("header"), F.lit(""), router_prefixes(c("content"))))
        .when(is_js & (kind == "method"), decorator_route(c("header"), class_path))
        .when(is_java & (kind == "method") & c("header").rlike(r"Mapping\b"), decorator_route(c("header"), class_path))
    )
    route = F.when(kind == "route", c("name")).when(is_js & (symbol == "function"), route_of_file(c("path"), c("symbol_name"))).otherwise(decorated)
    limit = (
        F.when(symbol == "route", C.CLIP_LINES["route"]).when(is_js & symbol.isin("type", "enum"), C.CLIP_LINES["type"])
        .when((symbol == "class") | (is_py & (symbol == "model")) | (is_java & ~symbol.isin("method")) | (is_go & ~symbol.isin("function", "method")),
              C.CLIP_LINES["class"]).otherwise(C.CLIP_LINES["entity"])
    )
    no_calls = (symbol == "class") | (is_js & symbol.isin("interface", "type", "enum")) | (is_py & (symbol == "model")) | (is_java & ~symbol.isin("method")) | (is_go & symbol.isin("class", "interface", "type"))
    own_name = F.when(kind == "route", F.lit("(")).otherwise(c("symbol_name"))
    calls = F.when(no_calls, F.array().cast("array<string>")).otherwise(call_names(_call_text(own_name, lang, c("code")), max_calls, lang))
    last_argument = F.substring_index(F.regexp_extract(F.regexp_replace("body", r"\s+", " "), r",\s*([\w$.]+)\s*,?\s*\)\s*;?\s*$", 1), ".", -1)
    handler = F.when((kind == "route") & (last_argument != "") & ~last_argument.rlike(r"^\d"), last_argument)
    calls = F.when(kind == "route", F.array_remove(calls, c("receiver"))).otherwise(calls)
    return rows.select(
        "repository_id", c("path").alias("file_path"), "symbol_name", "symbol_type", "language", c("first").cast("long").alias("start_line"),
        c("end").cast("long").alias("end_line"), (clip(lines, c("first"), c("end"), limit) if clipped else c("body")).alias("content"), parent.alias("parent"),
        exported.alias("exported"), route.alias("route"), calls.alias("calls"), handler.alias("handler"),
    )


def extract_imports(files: DataFrame) -> DataFrame:
    """(repository_id, file_path, spec) of every import in the file's language."""
    text, lang = F.col("content"), F.col("language")
    every = lambda pattern, source=text, group=1: F.regexp_extract_all(source, F.lit(pattern), F.lit(group))
    bare = F.regexp_replace(text, r"(?m)^\s*//[^\n]*|/\*[\s\S]*?\*/", "")
    js = F.concat(
        every(r"(?m)^\s*import\s+(?:type\s+)?(?:[\w$*{}\s,]+?\s+from\s+)?['\"]([^'\"]+)['\"]", bare),
        every(r"(?m)^\s*export\s+(?:type\s+)?(?:\*(?:\s+as\s+[\w$]+)?|\{[^}]*\})\s*from\s*['\"]([^'\"]+)['\"]", bare),
        every(r"\brequire\(\s*['\"]([^'\"]+)['\"]\s*\)", bare),
    )
    java = every(r"(?m)^\s*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;")
    go = F.concat(
        every(r"(?m)^import\s+(?:[\w.]+\s+)?\"([^\"]+)\""),
        F.flatten(F.transform(every(r"(?m)^import\s*\(([^)]*)\)"), lambda block: every(r"\"([^\"]+)\"", block))),
    )
    unaliased = lambda n: F.regexp_replace(F.trim(n), r"\s+as\s+\w+$", "")
    plain = F.flatten(F.transform(every(r"(?m)^import[ \t]+([^\n#;]+)"), lambda line: F.transform(F.split(line, ","), unaliased)))

    def from_import(statement: Column) -> Column:
        module = F.regexp_extract(statement, r"^from\s+(\.*[\w.]*)", 1)
        names = F.split(F.regexp_replace(F.regexp_extract(statement, r"import\s*([\s\S]*)$", 1), r"[()]|#[^\n]*", " "), ",")
        cleaned = F.filter(F.transform(names, lambda n: unaliased(F.regexp_replace(n, r"\s+", " "))), lambda n: n.rlike(r"^[\w.]+$"))
        joint = F.when(module.endswith("."), module).otherwise(F.concat(module, F.lit(".")))
        return F.concat(F.array(module), F.transform(cleaned, lambda n: F.concat(joint, n)))

    froms = F.flatten(F.transform(every(r"(?m)^from\s+\.*[\w.]*\s+import\s*(?:\([^)]*\)|[^\n]+)", text, 0), from_import))
    specs = F.when(lang.isin(*JS), js).when(lang.isin(*PY), F.concat(plain, froms)).when(lang.isin(*JAVA), java).when(lang.isin(*GO), go)
    parsed = files.where(lang.isin(*PARSED))
    out = parsed.select("repository_id", F.col("path").alias("file_path"), F.explode_outer(F.array_distinct(specs)).alias("spec"))
    return out.where(F.col("spec").isNotNull() & (F.col("spec") != ""))
