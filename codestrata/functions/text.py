"""Column functions over questions, identifiers and source text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import constants as C


def _spaced_camel(text: Column) -> Column:
    return F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2")


def identifier_words(text: Column) -> Column:
    """The text followed by itself with camelCase, acronyms, separators and paths split into words."""
    acronyms = F.regexp_replace(_spaced_camel(text), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.concat_ws(" ", text, F.regexp_replace(acronyms, r"[_\-./\\:]+", " "))


def keyword_terms(question: Column, limit: int | None = None) -> Column:
    """Distinct lower-case search terms in first-seen order: each identifier, then its camel and underscore parts."""
    tokens = F.regexp_extract_all(question, F.lit(C.WORD_PATTERN), F.lit(0))
    parts = F.flatten(F.transform(tokens, lambda t: F.concat(F.array(t), F.split(_spaced_camel(t), r"[\s_]+"))))
    lowered = F.transform(parts, F.lower)
    terms = F.array_distinct(F.filter(lowered, lambda t: (F.length(t) >= 2) & ~t.isin(*C.STOP_WORDS)))
    return terms if limit is None else F.slice(terms, 1, limit)


def code_identifiers(question: Column) -> Column:
    """Distinct code-like names: backticked first, then `name()` mentions, then camelCase / PascalCase / snake_case."""
    quoted = F.transform(
        F.regexp_extract_all(question, F.lit(C.BACKTICK_PATTERN), F.lit(1)),
        lambda t: F.substring_index(F.regexp_replace(t, r"\(\)$", ""), ".", -1),
    )
    called = F.regexp_extract_all(question, F.lit(C.CALL_MENTION_PATTERN), F.lit(1))
    shaped = F.regexp_extract_all(question, F.lit(C.IDENTIFIER_PATTERN), F.lit(1))
    return F.array_distinct(F.concat(quoted, called, shaped))


def long_terms(terms: Column) -> Column:
    return F.filter(terms, lambda t: F.length(t) >= 4)


def symbol_candidates(identifiers: Column, terms: Column) -> Column:
    return F.array_distinct(F.transform(F.concat(identifiers, long_terms(terms)), F.lower))


def classify_question(question: Column) -> Column:
    text = F.lower(question)
    (first, pattern), *others = C.QUESTION_PATTERNS
    chain = F.when(text.rlike(pattern), first)
    for label, pattern in others:
        chain = chain.when(text.rlike(pattern), label)
    return chain.otherwise("general")


def is_about_tests(question: Column) -> Column:
    return question.rlike(C.ABOUT_TESTS_PATTERN)


def external_imports(imports: Column) -> Column:
    return F.filter(imports, lambda i: ~i.startswith("."))


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def is_blank(text: Column) -> Column:
    return ~text.rlike(C.JS_NON_SPACE)


def clip(lines: Column, start: Column, end: Column, limit: Column | int | None = None) -> Column:
    """Lines start..end (1-based, inclusive) as text, cut to `limit` lines."""
    count = end - start + 1
    if limit is not None:
        count = F.least(count, limit if isinstance(limit, Column) else F.lit(limit))
    return F.array_join(F.slice(lines, start, F.greatest(count, F.lit(0))), "\n")


def numbered(content: Column, start: Column, limit: Column) -> Column:
    """First `limit` lines, each prefixed with its line number unless it has one, and a note of how many are left."""
    lines = lines_of(content)
    shown = F.transform(
        F.slice(lines, F.lit(1), limit),
        lambda line, i: F.when(line.rlike(r"^\d+: "), line).otherwise(
            F.concat((start + i).cast("string"), F.lit(": "), line)
        ),
    )
    left = F.size(lines) - limit
    note = F.concat(F.lit("... ("), left.cast("string"), F.lit(" more lines)"))
    return F.array_join(F.concat(shown, F.when(left > 0, F.array(note)).otherwise(F.array().cast("array<string>"))), "\n")


def evidence_header(number, symbol_type, parent, name, route, path, start, end, module, reason) -> Column:
    """'[S1] method Owner.name (route GET /x) — path:1-9 (module: m; reason)'."""
    owner = F.when(F.coalesce(parent, F.lit("")) != "", F.concat(parent, F.lit("."))).otherwise("")
    routed = F.when(F.coalesce(route, F.lit("")) != "", F.concat(F.lit(" (route "), route, F.lit(")"))).otherwise("")
    return F.concat(
        F.lit("[S"), number.cast("string"), F.lit("] "), symbol_type, F.lit(" "), owner, name, routed,
        F.lit(" — "), path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"),
        F.lit(" (module: "), module, F.lit("; "), reason, F.lit(")"),
    )


def embedding_text(symbol_type, name, parent, route, path, content, content_chars: int | None = None):
    """Text an entity is embedded from: type, name, owner, route, path, split identifiers, content (its first `content_chars`)."""
    body = content if content_chars is None else F.substring(content, 1, content_chars)
    return F.concat_ws(" ", symbol_type, name, parent, route, path, identifier_words(name), body)


def route_method(route: Column) -> Column:
    return F.substring_index(route, " ", 1)


def route_path(route: Column) -> Column:
    return F.when(F.instr(route, " ") > 0, F.substring(route, F.instr(route, " ") + 1, F.length(route))).otherwise("")


def route_matches(route: Column, path: Column, name: Column, needle: str) -> Column:
    return F.contains(F.lower(F.concat_ws(" ", route, path, name)), F.lower(F.lit(needle)))


def symbol_contains(name: Column, needle: str) -> Column:
    return F.contains(F.lower(name), F.lower(F.lit(needle)))


def code_reference(text: Column) -> Column:
    """'path.ext:12-30' as struct(path, start_line, end_line); null where the text is something else."""
    part = lambda i: F.regexp_extract(text, C.CODE_REFERENCE_PATTERN, i)
    number = lambda i: F.when(part(i) != "", part(i).cast("long"))
    return F.when(
        text.rlike(C.CODE_REFERENCE_PATTERN),
        F.struct(part(1).alias("path"), number(2).alias("start_line"), number(3).alias("end_line")),
    )


def call_names(text: Column, limit: int | None = None, language: Column | None = None) -> Column:
    """Distinct names that are called in `text`, last name of a member chain, the language's keywords left out."""
    found = F.regexp_extract_all(text, F.lit(r"([A-Za-z_$][\w$]*)\s*\("), F.lit(1))

    def is_keyword(name: Column) -> Column:
        common = name.isin(*CALL_KEYWORDS[""])
        if language is None:
            return common
        for lang, words in CALL_KEYWORDS.items():
            if lang:
                common = common | ((language == lang) & name.isin(*words))
        return common

    names = F.array_distinct(F.filter(found, lambda n: ~is_keyword(n)))
    return names if limit is None else F.slice(names, 1, limit)


# Words that stand before a parenthesis without being called: in every language, and in one.
CALL_KEYWORDS = {
    "": ("if", "for", "while", "switch", "return", "else"),
    "TypeScript": ("catch", "function", "typeof", "await", "async", "new", "throw", "do", "yield", "delete", "void", "super", "in", "of", "case"),
    "JavaScript": ("catch", "function", "typeof", "await", "async", "new", "throw", "do", "yield", "delete", "void", "super", "in", "of", "case"),
    "Python": ("and", "or", "not", "in", "is", "elif", "except", "lambda", "with", "await", "yield", "assert", "del", "raise", "import", "from", "def", "class"),
    "Java": ("catch", "new", "throw", "synchronized", "assert", "super", "this", "try", "do", "case"),
    "Go": ("func", "go", "defer", "select", "range", "interface", "struct", "map", "chan", "case", "var", "const", "type", "import"),
}


def chunk_type(language: Column) -> Column:
    return F.when(language == "Markdown", "doc").when(~language.isin(*C.NON_SOURCE_LANGUAGES), "chunk").otherwise("config")


def severity(depth: Column) -> Column:
    return F.when(depth == 1, "HIGH").when(depth == 2, "MEDIUM").otherwise("LOW")


def impact_reason(depth: Column, relationship: Column, via_name: Column, target_name: Column) -> Column:
    verb = F.when(relationship == "handles", "is a route handled by ").otherwise("directly calls ")
    direct = F.concat(verb, F.coalesce(via_name, target_name), F.lit("()"))
    indirect = F.concat(F.lit("calls "), via_name, F.lit("(), which depends on "), target_name)
    return F.when(depth == 1, direct).otherwise(indirect)


def header_of(lines: Column, start: Column, below: Column) -> Column:
    """Up to six decorator lines directly above `start`, then the first `below` lines from it."""
    first = F.greatest(start - 6, F.lit(1))
    window = F.reverse(F.slice(lines, first, start - first))
    initial = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("stop"))

    def step(acc: Column, line: Column) -> Column:
        trimmed = F.trim(line)
        belongs = trimmed.startswith("@") | ((F.size(acc["kept"]) > 0) & trimmed.rlike(r"^[)\]},]"))
        keep = ~acc["stop"] & belongs
        return F.struct(
            F.when(keep, F.concat(F.array(line), acc["kept"])).otherwise(acc["kept"]).alias("kept"),
            (acc["stop"] | ~belongs).alias("stop"),
        )

    above = F.aggregate(window, initial, step, lambda acc: acc["kept"])
    return F.array_join(F.concat(above, F.slice(lines, start, below)), "\n")
