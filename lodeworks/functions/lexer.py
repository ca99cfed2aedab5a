"""Lexical facts of C# texts: tokens, comments, identifiers, string literals."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame

_TOKEN = regex.compile(
    r'(?P<comment>//[^\n]*|/\*.*?(?:\*/|$))|(?P<raw>\$*"""+.*?"""+)|(?P<string>(?:\$@|@\$|@)"(?:""|[^"])*"|\$?"(?:\\.|[^"\\\n])*")|(?P<char>\'(?:\\.|[^\'\\\n])+\')'
    r"|(?P<number>0[xXbB][\da-fA-F_]+[a-zA-Z]*|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?[a-zA-Z]*)|(?P<escaped>@[\p{L}_][\p{L}\p{N}_]*|[\p{L}_]*\\u[\da-fA-F]{4}[\p{L}\p{N}_]*)|(?P<word>[\p{L}_][\p{L}\p{N}_]*)"
    r"|(?P<op>\?\?=|<<=|>>=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.|\+\+|--|->|::|[+\-*/%&|^]=|\S)",
    regex.DOTALL,
)
KEYWORDS = frozenset(
    "abstract as base bool break byte case catch char checked class const continue decimal default delegate do double else enum event explicit extern false finally fixed float for foreach goto if implicit in int interface internal is lock long namespace new null object operator out override params private protected public readonly ref return sbyte sealed short sizeof stackalloc static string struct switch this throw true try typeof uint ulong unchecked unsafe ushort using virtual void volatile while".split()
)


def lex(text: str) -> Iterator[tuple[str, str, int, int, str]]:
    """(kind, token, line, character, source) in source order; kinds: token, comment. Lines from 1, characters from 0."""
    line, begin, seen = 1, 0, 0
    for m in _TOKEN.finditer(text or ""):
        line += text.count("\n", seen, m.start())
        begin = text.rfind("\n", 0, m.start()) + 1
        seen = m.start()
        kind = m.lastgroup
        source = m[0]
        token = {"raw": "STR", "string": "STR", "char": "CHR", "number": "NUM", "escaped": "ESCID"}.get(kind) or (source if kind == "op" or source in KEYWORDS else "ID")
        yield "comment" if kind == "comment" else "token", "" if kind == "comment" else token, line, m.start() - begin, source


def without_usings(tokens: list[tuple]) -> list[tuple]:
    """Tokens without using directives and extern aliases (those that stand before a semicolon and hold no parenthesis)."""
    out, i = [], 0
    while i < len(tokens):
        starts = i == 0 or tokens[i - 1][1] in (";", "{", "}")
        using = tokens[i][1] == "using" or tokens[i][4] == "global" and i + 1 < len(tokens) and tokens[i + 1][1] == "using" or tokens[i][1] == "extern"
        if starts and using:
            end = next((k for k in range(i, len(tokens)) if tokens[k][1] in (";", "(", "{")), len(tokens))
            if end < len(tokens) and tokens[end][1] == ";":
                i = end + 1
                continue
        out.append(tokens[i])
        i += 1
    return out


def _rows(kind: str, path: str, text: str) -> Iterator[tuple]:
    every = list(lex(text))
    if kind == "comments":
        for k, _, line, ch, source in every:
            if k == "comment":
                yield path, line, ch, "block" if source.startswith("/*") else "line", source
        return
    tokens = [t for t in every if t[0] == "token"]
    if kind == "tokens":
        for i, (_, t, line, ch, _) in enumerate(without_usings(tokens)):
            yield path, i, t, line, ch
    elif kind == "identifiers":
        for _, t, line, _, source in tokens:
            if t == "ID":
                yield path, line, source
    elif kind == "string_literals":
        for _, t, _, _, source in tokens:
            if t == "STR":
                yield path, source.strip('$@"')


SCHEMAS = {
    "tokens": "path string, idx int, tok string, line int, ch int",
    "comments": "path string, line int, ch int, kind string, text string",
    "identifiers": "path string, line int, text string",
    "string_literals": "path string, text string",
}


def facts_of(files: DataFrame, kind: str) -> DataFrame:
    """A lexical fact table (a key of SCHEMAS) of files (path, text)."""
    names = [c.split()[0] for c in SCHEMAS[kind].split(", ")]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, text in zip(b["path"], b["text"], strict=True):
                yield pd.DataFrame(list(_rows(kind, path, text or "")), columns=names)

    return files.select("path", "text").mapInPandas(work, SCHEMAS[kind])
