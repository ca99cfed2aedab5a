"""Column functions for paths, names and code text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_to_regex(glob: str) -> str:
    """Anchored, case-blind regex: ``**/`` any folders, ``**`` anything, ``*`` and ``?`` within a segment."""
    out, i, glob = [], 0, glob.replace("\\", "/")
    while i < len(glob):
        if glob.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif glob.startswith("**", i):
            out.append(".*")
            i += 2
        elif glob[i] == "*":
            out.append("[^/]*")
            i += 1
        elif glob[i] == "?":
            out.append("[^/]")
            i += 1
        else:
            out.append(re.escape(glob[i]))
            i += 1
    return "(?i)^" + "".join(out) + "$"


def matches_glob(path: Column, glob: str) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/")).rlike(glob_to_regex(glob))


def first_glob(path: Column, globs: list[str]) -> Column:
    """The first glob that matches, null if none does."""
    found = F.lit(None).cast("string")
    for g in reversed(globs):
        found = F.when(matches_glob(path, g), F.lit(g)).otherwise(found)
    return found


def namespace_prefixes(ns: Column) -> Column:
    """``a.b.c`` -> [a, a.b, a.b.c]; null is the global namespace."""
    parts = F.split(F.coalesce(ns, F.lit("<global>")), "\\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))


def namespace_covered(ns: Column, excluded: list[str]) -> Column:
    """Whether an excluded namespace is this one or one around it."""
    if not excluded:
        return F.lit(False)
    return F.arrays_overlap(namespace_prefixes(ns), F.array(*map(F.lit, excluded)))


def is_generated(path: Column) -> Column:
    """Build output or a generated file by its name."""
    return F.lower(F.replace(path, F.lit("\\"), F.lit("/"))).rlike(r"/obj/|\.g\.cs$|\.g\.i\.cs$|\.designer\.cs$|\.assemblyinfo\.cs$|\.assemblyattributes\.cs$")


def is_test_code(path: Column, project: Column | None = None) -> Column:
    """A folder named test or tests, or a project whose last dotted part is Test or ends with Tests."""
    segments = F.split(F.lower(F.replace(path, F.lit("\\"), F.lit("/"))), "/")
    folders = F.slice(segments, F.lit(1), F.size(segments) - 1)
    found = F.exists(folders, lambda s: s.isin("test", "tests"))
    if project is not None:
        last = F.lower(F.element_at(F.split(project, "\\."), -1))
        found = found | (last == "test") | last.endswith("tests")
    return F.coalesce(found, F.lit(False))


def common_folder(paths: Column) -> Column:
    """The deepest folder around all paths of an array: its smallest and largest path agree as far as all do."""
    low, high = F.split(F.array_min(paths), "/"), F.split(F.array_max(paths), "/")
    most = F.least(F.size(low), F.size(high)) - 1
    depths = F.filter(F.sequence(F.lit(0), most), lambda n: F.slice(low, F.lit(1), n) == F.slice(high, F.lit(1), n))
    return F.array_join(F.slice(low, F.lit(1), F.array_max(depths)), "/")


def fnv1a(tokens: Column) -> Column:
    """32-bit FNV-1a of an array of ASCII tokens, each ended by 0x1F, as a long."""
    mask = F.lit(4294967295)

    def mix(h: Column, byte: Column) -> Column:
        return (h.bitwiseXOR(byte.cast("bigint")) * F.lit(16777619)).bitwiseAND(mask)

    def token(h: Column, t: Column) -> Column:
        chars = F.transform(F.filter(F.split(t, ""), lambda c: c != ""), lambda c: F.ascii(c))
        return mix(F.aggregate(chars, h, mix), F.lit(31))

    return F.aggregate(tokens, F.lit(2166136261).cast("bigint"), token)


def version_struct(version: Column) -> Column:
    """(major, minor, patch, revision, release, prerelease), comparable; a release comes after its prereleases."""
    core = F.regexp_extract(version, r"^\s*[\[(]?\s*v?(\d+(?:\.\d+)*)", 1)
    parts = F.split(core, "\\.")
    number = lambda i: F.coalesce(F.expr("0").cast("bigint") + F.get(parts, F.lit(i)).try_cast("bigint"), F.lit(0).cast("bigint"))
    pre = F.regexp_extract(version, r"^\s*[\[(]?\s*v?\d+(?:\.\d+)*-([0-9A-Za-z.\-]+)", 1)
    return F.struct(number(0).alias("major"), number(1).alias("minor"), number(2).alias("patch"), number(3).alias("revision"), (pre == "").alias("release"), pre.alias("prerelease"))


def iso_to_utc(text: Column) -> Column:
    """An ISO-8601 date and time, with any offset, as ``yyyy-MM-ddTHH:mm:ssZ`` in UTC; null if it is none. The session's zone is UTC."""
    return F.date_format(F.try_to_timestamp(text), "yyyy-MM-dd'T'HH:mm:ss'Z'")
