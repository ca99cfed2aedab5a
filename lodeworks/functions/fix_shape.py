"""Whether the added lines of a change look like a fix: column functions over arrays of lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_LITERALS = r"""\$?@?"(?:[^"\\]++|""|\\.)*+"|'(?:[^'\\]++|\\.)*+'"""
_COMMENTS = r"//.*$|/\*.*?\*/"
_SHAPES = r"(?i)==\s*null\b|!=\s*null\b|\bis\s+(?:not\s+)?null\b|\?\.|\?\?|\bthrowif\w*\s*\(|\b(?:count|length)\b\s*(?:\(\s*\)\s*)?(?:[<>]=?|[=!]=)|\bisnullor(?:empty|whitespace)\s*\("
_STARTS = r"^\s*\}?\s*(?:try|catch|finally|throw)\b"
_NONE = "cast(array() as array<string>)"
SHORTEST = 12


def code_of(line: Column) -> Column:
    """A line without literals and comments."""
    return F.regexp_replace(F.regexp_replace(line, _LITERALS, '""'), _COMMENTS, "")


def line_is_fix(line: Column, removed: Column) -> Column:
    """A fix's shape in a line that no removed line has, whole or, from ``SHORTEST`` characters on, in part."""
    code, text = code_of(line), F.btrim(line)

    def there(old: Column) -> Column:
        r = F.btrim(old)
        both = (F.length(text) >= SHORTEST) & (F.length(r) >= SHORTEST)
        return F.coalesce((text == r) | both & (r.contains(text) | text.contains(r)), F.lit(False))

    return code.rlike(r"\w") & (code.rlike(_SHAPES) | code.rlike(_STARTS)) & ~F.exists(removed, there)


def fix_shaped(added: Column, removed: Column) -> Column:
    """Of array<string> columns; null arrays are empty, null lines no fix."""
    old = F.coalesce(removed, F.expr(_NONE))
    return F.exists(F.coalesce(added, F.expr(_NONE)), lambda x: F.coalesce(line_is_fix(x, old), F.lit(False)))


def skeleton(lines: Column) -> Column:
    """What is no letter, digit or underscore, white space and line breaks included."""
    return F.concat_ws("", F.transform(lines, lambda x: F.concat(F.regexp_replace(x, r"[\p{L}\p{Nd}_]+", ""), F.lit("\n"))))


def rename_only(added: Column, removed: Column) -> Column:
    """Both sides have lines, and one skeleton."""
    there = (F.coalesce(F.size(added), F.lit(0)) > 0) & (F.coalesce(F.size(removed), F.lit(0)) > 0)
    return there & (skeleton(added) == skeleton(removed))
