"""Line dedup by a segment-partition edit join (operator 3), DataFrame functions only.

A line goes when the same line, or one within one edit, occurs earlier in the corpus, however short the two are; order is by
doc_id, then line number. Lines are compared without white space at their ends; blank lines stay.

Equal lines meet by a 128-bit hash in an aggregation. Distinct lines then meet in the edit join:

* Segments. With a threshold of one edit a line has two segments, and a line within one edit has one of them unchanged,
  at its start or its end. A line of length b is indexed under (b, side, segment); a line of length b + 1 probes the index of
  length b as well, so all lengths in range meet. Keys are counted with a map-side combine, and lone ones drop out.
* Verification. The changed part of a pair is narrowed by comparing halves, then goes through a banded bit-parallel edit
  distance: the columns of the matrix as bit vectors of the band, folded over the characters.
* Crowded segments (more than ``crowd`` lines) are not paired. Their lines are dealt out again under finer keys: the unchanged
  start and end around half of the part that may differ, and so on, until groups are small or the part is one
  character (all lines of a group differ in that one: every two are within one edit) or none (one line, and lines with one
  character more in that place). There an aggregate gives each line its earliest neighbour without any pair.
  Rounds are bounded by the logarithm of the longest crowded line, rows by the lines in crowded groups; nothing is dropped.

Small sides are broadcast only after a count (``BROADCAST_ROWS``); beyond it the same joins shuffle, and
adaptive execution splits a line that holds a third of all rows.

Defined cases: null and empty texts have no lines and stay as they are. Documents alike in id and text are one and share
decisions. A null doc_id comes after all others. All rows and columns stay, whatever their names, but for columns called as the
two of ``to``, which are replaced. No rows in, no rows out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.llm.rows import keys, named, packed, unpacked
from lodeworks.sources.shared import discard, stage

CROWD, BROADCAST_ROWS = 16, 1_000_000
WORD = 32  # bits of the band's word
MASK = (1 << WORD) - 1


def banded_distance(a: Column, b: Column, k: int) -> Column:
    """Edit distance of two texts, the first not the shorter, by at most k; right where it is k or less, else more than k.

    Hyyrö's bit vectors: bit WORD-1 is the band's lowest row. They move down a row with each character of ``b``.
    """
    bound = F.struct(F.split(a, "").alias("x"), F.split(b, "").alias("y"), F.length(a).alias("m"), F.length(b).alias("n"))
    return _once(bound, lambda v: _banded(v["x"], v["y"], v["m"], v["n"], k))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value made once: a lambda's variable."""
    return F.transform(F.array(value), use)[0]


def _banded(x: Column, y: Column, m: Column, n: Column, k: int) -> Column:
    """Of lists of characters of m and n elements."""
    top = 1 << (WORD - 1)
    flip = lambda c: c.bitwiseXOR(F.lit(MASK))

    def column(s: Column, j: Column) -> Column:
        vp, vn = s["vp"], s["vn"]
        eq = F.lit(0).cast("bigint")
        for d in range(-k, k + 1):
            same = F.get(x, j + d) == F.get(y, j)
            eq = eq.bitwiseOR(F.when((j + d >= 0) & (j + d < m) & same, F.lit(1 << (WORD - 1 - k + d))).otherwise(F.lit(0)).cast("bigint"))
        d0 = (eq.bitwiseAND(vp) + vp).bitwiseAND(F.lit(MASK)).bitwiseXOR(vp).bitwiseOR(eq).bitwiseOR(vn)
        vectors = lambda d: F.struct(d.alias("d0"), vn.bitwiseOR(flip(d.bitwiseOR(vp))).alias("hp"), d.bitwiseAND(vp).alias("hn"))

        def done(v: Column) -> Column:
            down = F.shiftright(v["d0"], 1)
            last_row = F.pow(F.lit(2.0), F.lit(WORD - 1) - (j + 1 + k - m)).cast("bigint")
            at_end = F.when(v["hp"].bitwiseAND(last_row) != 0, 1).otherwise(0) - F.when(v["hn"].bitwiseAND(last_row) != 0, 1).otherwise(0)
            on_edge = F.when(v["d0"].bitwiseAND(F.lit(top)) != 0, 0).otherwise(1)
            return F.struct(
                v["hn"].bitwiseOR(flip(down.bitwiseOR(v["hp"]))).alias("vp"),
                down.bitwiseAND(v["hp"]).alias("vn"),
                (s["cost"] + F.when(j < m - k, on_edge).otherwise(at_end)).alias("cost"),
            )

        return _once(_once(d0, vectors), done)

    start = F.struct(F.lit((MASK << (WORD - k - 1)) & MASK).cast("bigint").alias("vp"), F.lit(0).cast("bigint").alias("vn"), F.least(F.lit(k), m).alias("cost"))
    steps = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    return F.aggregate(steps, start, column, lambda s: s["cost"])


def _small(df: DataFrame) -> DataFrame:
    """A staged table, to be broadcast where its counted rows allow."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _key(base: Column, low: Column, high: Column, line: Column) -> Column:
    """The start and end of a line around the part [low, high) of a line of length ``base``."""
    return F.xxhash64(base, low, high, F.substring(line, F.lit(1), low), F.substring(line, F.length(line) - (base - high) + 1, base - high))


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r\f\v"))


def _lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    rows = docs.select(*keys(named(doc_id), named(text)), named(doc_id).alias("i"), F.posexplode(F.split(named(text), "\n")).alias("n", "l"))
    rows = rows.withColumn("l", _bare(F.col("l"))).where("l != ''")
    return rows.select("k1", "k2", F.struct(F.col("i").isNull().alias("z"), "i", F.col("k2").alias("k"), "n").alias("o"), "n", "l", F.xxhash64("l").alias("h1"), F.xxhash64(F.lit(1), "l").alias("h2"))


def _level_keys() -> Column:
    """Index and probe keys of a line: array of struct(key, role, side); role 1 probes the index of one character less."""
    line, size = F.col("l"), F.length("l")
    out = []
    for role in (0, 1):
        base = size - role
        half = F.floor(base / 2).cast("int")
        for side, low, high in ((0, half, base), (1, F.lit(0), half)):
            out.append(F.struct(_key(base, low, high, line).alias("key"), F.lit(role).alias("role"), F.lit(side).alias("side")))
    return F.array(*out)


def _neighbours(lines: DataFrame, rows: DataFrame, crowd: int) -> DataFrame:
    """(h1, h2, near): for lines of ``lines`` (h1, h2, l, first) the first occurrence of a line within one edit.

    rows: (key, role, lo, hi, h1, h2): candidates, [lo, hi) the part of the index's line that may differ.
    """
    found = None
    rows = rows.join(lines, ["h1", "h2"])
    while True:
        size = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("role").alias("r")).where("n > 1 and r = 0").select("key", "n")
        rows = stage(rows.join(size, "key"), "segments", gather=True)
        calm = rows.where(F.col("n") <= crowd)
        x, y = calm.where("role = 0").alias("x"), calm.alias("y")
        other = (F.col("y.role") == 1) | (F.col("x.h1") < F.col("y.h1")) | ((F.col("x.h1") == F.col("y.h1")) & (F.col("x.h2") < F.col("y.h2")))
        pair = x.join(y, (F.col("x.key") == F.col("y.key")) & other).select(
            F.col("x.h1").alias("a1"), F.col("x.h2").alias("a2"), F.col("x.l").alias("a"), F.col("x.first").alias("fa"),
            F.col("y.h1").alias("b1"), F.col("y.h2").alias("b2"), F.col("y.l").alias("b"), F.col("y.first").alias("fb"), F.col("x.lo").alias("lo"), F.col("x.hi").alias("hi"),
        )
        pair = _within_one(pair)
        here = pair.select(F.col("b1").alias("h1"), F.col("b2").alias("h2"), F.col("fa").alias("near")).union(pair.select("a1", "a2", "fb"))
        crowded = rows.where(F.col("n") > crowd)
        # one character may differ: lines of the index's length are neighbours of each other; none: the one line of that
        # length and those with one character more
        tight = crowded.where("hi - lo = 1 and role = 0")
        w = tight.groupBy("key").agg(F.min("first").alias("near"))
        here = here.union(tight.join(w, "key").select("h1", "h2", "near"))
        gap = crowded.where("hi = lo")
        one = gap.groupBy("key").agg(F.min(F.when(F.col("role") == 0, F.col("first"))).alias("n0"), F.min(F.when(F.col("role") == 1, F.col("first"))).alias("n1"))
        here = here.union(gap.join(one, "key").select("h1", "h2", F.when(F.col("role") == 0, F.col("n1")).otherwise(F.col("n0"))))
        here = here.where("near is not null").groupBy("h1", "h2").agg(F.min("near").alias("near"))
        found = here if found is None else found.union(here)
        wide = crowded.where("hi > lo")
        if wide.isEmpty():
            break
        base, mid = F.length("l") - F.col("role"), F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        # of one character the finer parts are the places before and behind it
        part = lambda a, b: F.struct(a.alias("lo"), b.alias("hi"))
        lo, hi = F.col("lo"), F.col("hi")
        parts = F.when(hi - lo == 1, F.array(part(lo, lo), part(hi, hi))).otherwise(F.array(part(lo, mid), part(mid, hi)))
        finer = wide.select("h1", "h2", "l", "first", "role", base.alias("base"), F.explode(parts).alias("p"))
        rows = finer.select(_key(F.col("base"), F.col("p.lo"), F.col("p.hi"), F.col("l")).alias("key"), "role", F.col("p.lo").alias("lo"), F.col("p.hi").alias("hi"), "h1", "h2", "l", "first")
    return stage(found.groupBy("h1", "h2").agg(F.min("near").alias("near")), "neighbours", gather=True)


def _within_one(pair: DataFrame, halvings: int = 5) -> DataFrame:
    """Pairs within one edit; a has the index's length, [lo, hi) is the part of it that may differ, b is of a's length or one more."""
    a, b, more = F.col("a"), F.col("b"), F.length("b") - F.length("a")

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        before = F.substring(a, s["lo"] + 1, mid - s["lo"]) == F.substring(b, s["lo"] + 1, mid - s["lo"])
        behind = F.substring(a, mid + 1, s["hi"] - mid) == F.substring(b, mid + more + 1, s["hi"] - mid)
        half = lambda v: F.struct(F.when(v["f"], v["m"]).otherwise(s["lo"]).alias("lo"), F.when(v["f"], s["hi"]).otherwise(v["m"]).alias("hi"), (v["f"] | v["t"]).alias("ok"))
        return F.when(s["ok"], _once(F.struct(mid.alias("m"), before.alias("f"), behind.alias("t")), half)).otherwise(s)

    start = F.struct(F.col("lo").alias("lo"), F.col("hi").alias("hi"), F.lit(True).alias("ok"))
    narrow = F.aggregate(F.sequence(F.lit(1), F.lit(halvings)), start, halve)
    part = lambda t, s, extra: F.substring(t, s["lo"] + 1, s["hi"] - s["lo"] + extra)
    cost = _once(narrow, lambda s: F.when(s["ok"], banded_distance(part(b, s, more), part(a, s, F.lit(0)), 1)).otherwise(2))
    return pair.where(cost <= 1)


def repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", crowd: int = CROWD) -> DataFrame:
    """(k1, k2, n, doc, line): the lines that go, by document row and number, and where the earlier line is."""
    lines = _lines(docs, doc_id, text)
    distinct = stage(
        lines.select("h1", "h2", "o", _level_keys().alias("keys"))
        .groupBy("h1", "h2")
        .agg(F.min("o").alias("first"), F.count("*").alias("copies"), F.first("keys").alias("keys")),
        "lines",
    )
    each = distinct.select("h1", "h2", F.inline("keys"))
    shared = stage(each.groupBy("key").agg(F.count("*").alias("n"), F.min("role").alias("r")).where("n > 1 and r = 0").select("key"), "shared", gather=True)
    dealt = stage(each.join(_small(shared), "key"), "candidates", gather=True)
    wanted = stage(dealt.select("h1", "h2").distinct(), "wanted", gather=True)
    of = lines.select("h1", "h2", "l").join(_small(wanted), ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.first("l").alias("l"))
    some = stage(of.join(distinct.select("h1", "h2", "first"), ["h1", "h2"]), "texts", gather=True)
    base, half = F.length("l") - F.col("role"), F.floor((F.length("l") - F.col("role")) / 2).cast("int")
    low, high = F.when(F.col("side") == 0, half).otherwise(0), F.when(F.col("side") == 0, base).otherwise(half)
    place = dealt.join(some.select("h1", "h2", "l"), ["h1", "h2"]).select("key", "role", low.alias("lo"), high.alias("hi"), "h1", "h2")
    near = _neighbours(some, place, crowd)
    # of lines that occur once and have no earlier neighbour no occurrence goes
    known = distinct.select("h1", "h2", "first", "copies").join(near, ["h1", "h2"], "left")
    known = known.where((F.col("copies") > 1) | (F.col("near") < F.col("first"))).select("h1", "h2", F.least("first", "near").alias("kept"))
    every = lines.select("h1", "h2", "k1", "k2", "o", "n").join(known, ["h1", "h2"])
    return every.where(F.col("o") != F.col("kept")).select("k1", "k2", "n", F.col("kept.i").alias("doc"), F.col("kept.n").alias("line"))


def clean(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", crowd: int = CROWD, to: tuple[str, str] = ("lines_removed", "lines_kept")) -> DataFrame:
    """All documents and columns, ``text`` without the lines that go; columns ``to`` (replaced where present): lines that went, lines that stay and aren't blank."""
    gone = repeated_lines(docs, doc_id, text, crowd).groupBy("k1", "k2").agg(F.collect_set("n").alias("gone"))
    rows = packed(docs, i=doc_id, t=text).select("t", "row", *keys(F.col("i"), F.col("t"))).join(gone, ["k1", "k2"], "left").withColumn("lines", F.split("t", "\n"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    left = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.transform(stay, lambda i: F.get("lines", i)))
    rows = rows.withColumn("lines", left)
    filled = F.size(F.filter("lines", lambda x: _bare(x) != ""))
    new = {
        text: F.when(F.col("gone").isNull(), F.col("t")).otherwise(F.array_join("lines", "\n")),
        to[0]: F.coalesce(F.size("gone"), F.lit(0)),
        to[1]: F.when(F.col("t").isNull(), 0).otherwise(filled),
    }
    return unpacked(rows, docs.columns, new)
