"""One scan over a source file: what is code, what is text, and where statements begin inside lines.

A file becomes pieces, in order: its lines, and parts of a line where a definition begins inside it.  The code of a piece is its
text with strings, comments and regular expressions blanked, place for place; code nested in template strings stays.
"""

from __future__ import annotations

import itertools
import re

import pyarrow as pa
from pyspark.sql import Column, functions as F

PIECES = "array<struct<n:int,line:string,code:string,in_text:boolean>>"
SCRIPTS = ("TypeScript", "JavaScript")

_SINGLE, _DOUBLE = r"'(?:\\.|[^'\\\n])*'?", r'"(?:\\.|[^"\\\n])*"?'
_NOTES = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
TEXTS = {
    "Python": re.compile(rf'#[^\n]*|"""(?:\\.|(?!""").)*(?:"""|\Z)|\'\'\'(?:\\.|(?!\'\'\').)*(?:\'\'\'|\Z)|{_DOUBLE}|{_SINGLE}', re.S),
    "Java": re.compile(rf'{_NOTES}|"""(?:\\.|(?!""").)*(?:"""|\Z)|{_DOUBLE}|{_SINGLE}', re.S),
    "Go": re.compile(rf"{_NOTES}|`[^`]*(?:`|\Z)|{_DOUBLE}|{_SINGLE}", re.S),
}
SCRIPT_TOKEN = re.compile(
    rf"(?P<plain>[^'\"`{{}}/]+)|(?P<note>{_NOTES})|(?P<string>\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*')|(?P<template>`)|(?P<open>\{{)|(?P<close>\}})"
    r"|(?P<slash>/)|(?P<other>.)", re.S)
LAST_WORD = re.compile(r"[A-Za-z_$][\w$]*\Z")
TEMPLATE_TEXT = re.compile(r"(?:\\.|\$(?!\{)|[^\\`$])*", re.S)
REGEX = re.compile(r"/(?![*/>])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
#: Words behind which an operand is expected, so that a slash begins a regular expression and a quote a string.
BEFORE_OPERAND = frozenset("return typeof case in of instanceof new delete void throw do else yield await default from import export".split())

_BRACED = r"[A-Za-z_$#][\w$]*\s*(?:<[^<>]*>)?\s*\([^()]*\)\s*(?::[^={;]+)?\{"
INSIDE = re.compile(r"[{};]\s*[\w@$#<]")
#: What a definition begins with, for the part of a line behind a brace or a semicolon.
STARTS = {
    "script": re.compile(
        r"\s*(?:export\s|(?:abstract\s+)?class\s|(?:async\s+)?function\b|interface\s+\w|(?:const\s+)?enum\s+\w|type\s+\w+[^=;]*=|@\w"
        r"|(?:const|let|var)\s+[\w$]+\s*(?::[^=]+)?=\s*(?:async\b|function\b|class\b|\([^()]*\)\s*(?::[^=]+)?=>|[\w$]+\s*=>)"
        rf"|(?!(?:if|for|while|switch|catch|return|function|with)\b)(?:(?:public|private|protected|static|async|get|set|readonly|override)\s+)*{_BRACED})"),
    "Java": re.compile(
        r"\s*(?:@\w+(?:\([^)]*\))?\s*)*(?:(?:public|protected|private|static|final|abstract|sealed|synchronized|native|default|strictfp)\s+)*"
        r"(?:(?:class|interface|enum|record)\s+\w|(?!(?:return|new|throw|else|if|for|while|switch|catch|do|try|synchronized)\b)"
        r"(?:<[^>]+>\s*)?[\w.]+(?:<[^;(){}]*>)?(?:\[\])*\s+\w+\s*\([^()]*\)\s*(?:throws\s+[\w., ]+)?[{;]|[A-Z]\w*\s*\([^()]*\)\s*\{)"),
    "Go": re.compile(r"\s*(?:func\s|type\s+\w)"),
}


def _blank(text: str) -> str:
    """Spaces for all but line ends; quotes at both ends stay."""
    inner = re.sub(r"[^\n]", " ", text)
    if text[0] in "\"'`":
        inner = text[0] + inner[1:]
        if len(text) > 1 and text[-1] in "\"'`":
            inner = inner[:-1] + text[-1]
    return inner


def _plain(text: str, language: str) -> tuple[str, list[tuple[int, int]]]:
    """The code of a file, and the places of strings over several lines."""
    long: list[tuple[int, int]] = []

    def replace(found: re.Match) -> str:
        whole = found.group()
        if "\n" in whole and whole[0] in "\"'`":
            long.append(found.span())
        return _blank(whole)

    return TEXTS[language].sub(replace, text), long


def _script(text: str) -> tuple[str, list[tuple[int, int]]]:
    """The same for scripts: templates hold code, which holds templates; slashes and quotes are told by what stands before."""
    out, long, opened, at, operand = [], [], [], 0, False

    def template(start: int) -> int:
        """From behind a back quote or a nested part to the next one or the end."""
        end = TEMPLATE_TEXT.match(text, start).end()
        if "\n" in text[start:end]:
            long.append((start - 1, end))
        out.append(re.sub(r"[^\n]", " ", text[start:end]))
        if text.startswith("${", end):
            out.append(" {")
            opened.append(True)
            return end + 2
        out.append(text[end:end + 1])
        return end + 1

    while at < len(text):
        found = SCRIPT_TOKEN.match(text, at)
        kind, whole = found.lastgroup, found.group()
        end = found.end()
        if kind == "note" and whole.startswith("//") and at and text[at - 1] == ":":  # an address in running text
            kind, whole, end = "other", "//", at + 2
        if kind == "note":
            out.append(_blank(whole))
        elif kind == "string" and not (whole[0] == "'" and operand and at and (text[at - 1].isalnum() or text[at - 1] == "_")):
            out.append(_blank(whole))
            operand = True
        elif kind == "string":  # an apostrophe in running text
            out.append("'")
            end = at + 1
        elif kind == "template":
            out.append("`")
            end = template(at + 1)
            operand = not (opened and opened[-1] and text[end - 1] == "{")
        elif kind == "open":
            out.append("{")
            opened.append(False)
            operand = False
        elif kind == "close":
            out.append("}")
            if opened and opened.pop():
                end = template(end)
            operand = False
        elif kind == "slash" and not operand and (not at or text[at - 1] != "<") and (regex := REGEX.match(text, at)):
            out.append("/" + " " * (len(regex.group()) - 2) + "/")
            end, operand = regex.end(), True
        elif kind == "plain":
            out.append(whole)
            if seen := whole.rstrip():
                word = LAST_WORD.search(seen[-12:])  # no word of BEFORE_OPERAND is longer
                operand = word.group() not in BEFORE_OPERAND if word else seen[-1].isalnum() or seen[-1] in "_$)]"
        else:
            out.append(whole)
            operand = False
        at = end
    return "".join(out), long


def code_of(text: str, language: str) -> tuple[str, list[tuple[int, int]]]:
    """A file with everything blanked that is not code, place for place, and where its strings over several lines stand."""
    return _script(text) if language in SCRIPTS else _plain(text, language)


def _cuts(code: str, starts: re.Pattern | None) -> list[int]:
    """Places in a line behind a brace or a semicolon, outside parentheses, where a definition begins."""
    cuts, depth = [], 0
    if starts is None or not INSIDE.search(code):
        return cuts
    for i, letter in enumerate(code[:-1]):
        if letter in "([":
            depth += 1
        elif letter in ")]":
            depth = max(0, depth - 1)
        elif letter in "{};" and depth == 0 and starts.match(code, i + 1):
            cuts.append(i + 1)
    return cuts


def pieces(text: str, language: str) -> list[tuple[int, str, str, bool]]:
    """(line from 1, text, code, whether it begins inside a string) of every piece of a file."""
    code, long = code_of(text, language)
    starts = STARTS.get("script" if language in SCRIPTS else language)
    out, at, span = [], 0, 0
    for n, (line, own) in enumerate(zip(text.split("\n"), code.split("\n"), strict=True), 1):
        while span < len(long) and long[span][1] < at:
            span += 1
        in_text = span < len(long) and long[span][0] < at <= long[span][1] and at > 0
        cuts = [0, *_cuts(own, starts), len(line)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            out.append((n, line[a:b] if a == 0 else line[a:b].lstrip(), own[a:b] if a == 0 else own[a:b].lstrip(), in_text and a == 0))
        at += len(line) + 1
    return out


def file_pieces(content: Column, language: Column) -> Column:
    """Pieces (n, line, code, in_text) of files of a language in TEXTS or SCRIPTS."""

    @F.arrow_udf(PIECES)
    def run(texts: pa.Array, languages: pa.Array) -> pa.Array:
        made = [pieces(t or "", g) for t, g in zip(texts.to_pylist(), languages.to_pylist(), strict=True)]
        ends = pa.array([0, *itertools.accumulate(map(len, made))], pa.int32())
        columns = zip(("n", "line", "code", "in_text"), (pa.int32(), pa.string(), pa.string(), pa.bool_()), strict=True)
        values = [pa.array([p[i] for own in made for p in own], kind) for i, (_, kind) in enumerate(columns)]
        return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(values, ["n", "line", "code", "in_text"]))

    return run(content, language)


def file_code(content: Column, language: Column) -> Column:
    """The code of files, other languages as they are."""

    @F.arrow_udf("string")
    def run(texts: pa.Array, languages: pa.Array) -> pa.Array:
        known = {*TEXTS, *SCRIPTS}
        return pa.array([code_of(t or "", g)[0] if g in known else t for t, g in zip(texts.to_pylist(), languages.to_pylist(), strict=True)], pa.string())

    return run(content, language)
