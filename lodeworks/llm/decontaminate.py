"""Benchmark decontamination by template canonicalisation (operator 9), DataFrame functions only.

A text is turned into its template: numbers, units behind numbers and names (capitalised words inside a sentence) become
typed placeholders, all else is lower-cased words. Windows of ``width`` consecutive template tokens of the benchmark
items meet those of the documents by hash. A window with fewer literal words than placeholders is not used. Items left with
one such window or none, and those in scripts without spaces, are also searched by windows of their literal tokens (lower-cased), so that a
verbatim copy of any item is found.

Matches of a document and an item are put together by shift (place in the document less place in the item). Where the
item's matched windows hold placeholders, slots are checked: along a shift, one value of the item has to stand for one value
of the document throughout; where it does not, the windows over its slots don't count, the shift's others do. Equal numbers of the
item may become different ones, as they can be equal by chance; a number kept in one slot and changed in another is a contradiction. A document is contaminated by an item when
consistent shifts cover ``least`` of the item's windows, or one covers ``STRAIGHT`` consecutive windows (a passage of 50 tokens),
however long the item is. A question with other numbers or names is found so
(``reparameterised``), a text that only shares the pattern of its phrases is not.

Only hashes of benchmark windows are broadcast, after a count; beyond ``BROADCAST_ROWS`` the join shuffles. Documents' texts are not
shuffled; of documents that match items with slots, the tokens are.

Defined cases: null and empty texts and items match nothing. An item shorter than ``width`` tokens is one window of its own length; one of
fewer than ``FEWEST`` tokens is searched literally only, and one without a number or letter not at all. Equal items each give a row, a null item_id like any other. Rows alike in id and text give their rows once.
An empty benchmark contaminates nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.llm.rows import keys, named, packed, unpacked
from lodeworks.sources.shared import discard, noted, stage

WIDTH, FEWEST, LEAST, STRAIGHT, BROADCAST_ROWS = 8, 5, 0.3, 43, 1_000_000
NUMBER, UNIT, NAME = "0", "1", "2"
UNITS = "km|m|cm|mm|kg|g|mg|lb|lbs|l|ml|miles?|meters?|metres?|feet|foot|inch|inches|hours?|minutes?|seconds?|days?|weeks?|months?|years?|dollars?|euros?|pounds?|cents?|usd|eur|percent|degrees?"
_NUM = r"\d+(?:[.,]\d+)*"
_WORD = r"[\p{L}\p{M}]+"
_UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]"


def template(text: Column) -> Column:
    """The template's tokens, one for each of :func:`raw_tokens`."""
    t = F.regexp_replace(text, _NUM, f" {NUMBER} ")
    t = F.regexp_replace(t, rf"(?i)(?<= {NUMBER} {{1,2}})(?:{UNITS})(?![\p{{L}}\p{{M}}])", f" {UNIT} ")
    t = F.regexp_replace(t, r"(?=\p{Lu})(?<=[\p{L}\p{M}0-9,;:] {1,3})[\p{L}\p{M}]+", f" {NAME} ")
    return F.filter(F.split(F.lower(t), r"[^\p{L}\p{M}0-9]+"), lambda x: x != "")


def raw_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"{_NUM}|{_WORD}"), F.lit(0))


def literal_tokens(text: Column) -> Column:
    """Lower-cased numbers and words; each character of a script without spaces is a word."""
    return F.transform(F.regexp_extract_all(text, F.lit(rf"{_NUM}|{_UNSPACED}|[\p{{L}}\p{{M}}&&[^{_UNSPACED}]]+"), F.lit(0)), lambda x: F.lower(x))


def windows(tokens: Column, width: Column | int) -> Column:
    """Hash of each window, in order; width is part of the hash."""
    last = F.size(tokens) - width
    each = F.transform(F.sequence(F.lit(1), last + 1), lambda i: F.xxhash64(F.slice(tokens, i, width), F.lit(width) if isinstance(width, int) else width))
    return F.when(last >= 0, each)


def straight(places: Column) -> Column:
    """Whether ``STRAIGHT`` consecutive windows are among the places of one shift."""
    at = F.array_sort(places)
    return F.coalesce(F.exists(F.transform(at, lambda p, i: F.get(at, i + STRAIGHT - 1) == p + STRAIGHT - 1), lambda x: F.coalesce(x, F.lit(False))), F.lit(False))


def literal_leaks(docs: DataFrame, items: DataFrame, doc_id: str, text: str, width: int, least: float) -> DataFrame:
    """(k1, k2, doc_id, item, coverage, reparameterised) by windows of literal tokens; ``items``: item, words."""
    items = items.where(F.size("words") > 0).withColumn("w", F.least(F.size("words"), F.lit(width)))
    each = stage(items.select("item", F.posexplode(windows(F.col("words"), F.col("w"))).alias("ipos", "h"), (F.size("words") - F.col("w") + 1).alias("windows")), "literals")
    widths = sorted(r[0] for r in items.select("w").distinct().collect())  # between 1 and width
    none = F.expr("cast(array() as array<bigint>)")
    located = [F.transform(F.coalesce(windows(F.col("words"), n), none), lambda h, i: F.struct(i.alias("dpos"), h.alias("h"))) for n in widths or [width]]
    rows = docs.select(*keys(named(doc_id), named(text)), named(doc_id).alias("doc_id"), literal_tokens(named(text)).alias("words"))
    few = each.count() <= BROADCAST_ROWS
    met = rows.select("k1", "k2", "doc_id", F.inline(F.concat(*located))).join(F.broadcast(each) if few else each, "h")
    by = ["k1", "k2", "doc_id", "item"]
    met = met.groupBy(*by, (F.col("dpos") - F.col("ipos")).alias("shift")).agg(F.collect_set("ipos").alias("places"), F.max("windows").alias("windows"))
    met = met.groupBy(*by).agg(F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("n"), F.max(straight(F.col("places"))).alias("long"), F.max("windows").alias("windows"))
    share = F.col("n") / F.col("windows")
    return met.where((share >= least) | F.col("long")).select("k1", "k2", "doc_id", "item", share.alias("coverage"), F.lit(False).alias("reparameterised"))


def leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WIDTH, least: float = LEAST) -> DataFrame:
    """(k1, k2, doc_id, item_id, coverage, reparameterised) of each contaminated document and item."""
    items = benchmark.select(F.monotonically_increasing_id().alias("item"), F.col(item_id).alias("item_id"), template(F.col(item_text)).alias("tokens"), raw_tokens(F.col(item_text)).alias("raw"), literal_tokens(F.col(item_text)).alias("words"), F.col(item_text).rlike(_UNSPACED).alias("unspaced"))
    every = stage(items, "items")
    items = every.drop("words", "unspaced").where(F.size("tokens") >= FEWEST).withColumn("w", F.least(F.size("tokens"), F.lit(width)))
    items = stage(items.withColumn("slots", F.exists("tokens", lambda t: t.isin(NUMBER, UNIT, NAME))), "items")
    each = items.select("item", "tokens", "w", "slots", F.posexplode(windows(F.col("tokens"), F.col("w"))).alias("ipos", "h"))
    held = F.size(F.filter(F.slice("tokens", F.col("ipos") + 1, F.col("w")), lambda t: t.isin(NUMBER, UNIT, NAME)))
    each = stage(each.where(held * 2 <= F.col("w")).select("item", "ipos", "h", "w", "slots"), "windows")
    total = each.groupBy("item").agg(F.count("*").alias("windows"))
    widths = sorted(r[0] for r in items.select("w").distinct().collect())  # between FEWEST and width
    if not widths:
        widths = [width]
    if len(widths) == 1:
        seen = F.posexplode(windows(F.col("tokens"), widths[0])).alias("dpos", "h")
    else:
        located = [F.transform(F.coalesce(windows(F.col("tokens"), n), F.expr("cast(array() as array<bigint>)")), lambda h, i: F.struct(i.alias("dpos"), h.alias("h"))) for n in widths]
        seen = F.inline(F.concat(*located))
    rows = docs.select(*keys(named(doc_id), named(text)), named(doc_id).alias("doc_id"), template(named(text)).alias("tokens"))
    few = each.count() <= BROADCAST_ROWS
    known = each.select("item", "ipos", "h", "slots")
    met = rows.select("k1", "k2", "doc_id", seen).join(F.broadcast(known) if few else known, "h")
    met = met.withColumn("shift", F.col("dpos") - F.col("ipos"))
    by = ["k1", "k2", "doc_id", "item", "shift"]
    met = stage(met.groupBy(*by).agg(F.collect_set("ipos").alias("places"), F.max("slots").alias("slots")), "shifts")
    plain = met.where(~F.col("slots")).select(*by, "places", F.lit(False).alias("changed"))
    with_slots = met.where("slots")
    whom = with_slots.select("k1", "k2").distinct()
    near = F.broadcast(whom) if whom.count() <= BROADCAST_ROWS else whom
    words = docs.select(*keys(named(doc_id), named(text)), named(text).alias("t")).join(near, ["k1", "k2"], "left_semi").select("k1", "k2", raw_tokens(F.col("t")).alias("doc_raw")).dropDuplicates(["k1", "k2"])
    both = with_slots.join(words, ["k1", "k2"]).join(items.select("item", "tokens", "raw", "w"), "item")
    under = F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + F.col("w") - 1))))
    marks = F.filter(under, lambda i: F.get("tokens", i).isin(NUMBER, UNIT, NAME))
    key = lambda i: F.struct(F.get("tokens", i).alias("kind"), F.lower(F.get("raw", i)).alias("was"))
    slot = F.transform(marks, lambda i: F.struct(*(key(i)[k].alias(k) for k in ("kind", "was")), F.lower(F.get("doc_raw", i + F.col("shift"))).alias("now")))
    both = both.withColumn("marks", marks).withColumn("s", F.array_sort(F.array_distinct(slot)))
    slots_of = F.transform("s", lambda x: F.struct(x["kind"].alias("kind"), x["was"].alias("was")))
    twice = F.array_distinct(F.filter(slots_of, lambda x, i: F.coalesce((i > 0) & (F.get(slots_of, i - 1) == x), F.lit(False))))
    same = lambda x: F.array_contains("s", F.struct(x["kind"].alias("kind"), x["was"].alias("was"), x["was"].alias("now")))
    both = both.withColumn("torn", F.filter(twice, lambda x: (x["kind"] != NUMBER) | same(x)))
    both = both.withColumn("bad", F.when(F.size("torn") > 0, F.filter("marks", lambda i: F.array_contains("torn", key(i)))))
    whole = F.filter("places", lambda p: ~F.exists("bad", lambda i: (i >= p) & (i < p + F.col("w"))))
    both = both.withColumn("places", F.when(F.col("bad").isNull(), F.col("places")).otherwise(whole)).where(F.size("places") > 0)
    checked = both.select(*by, "places", F.exists("s", lambda x: ~x["was"].eqNullSafe(x["now"])).alias("changed"))
    covered = plain.unionByName(checked).groupBy("k1", "k2", "doc_id", "item").agg(F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("n"), F.max(straight(F.col("places"))).alias("long"), F.min("changed").alias("reparameterised"))
    share = F.col("n") / F.col("windows")
    names = every.select("item", "item_id")
    found = covered.join(total, "item").where((share >= least) | F.col("long")).select("k1", "k2", "doc_id", "item", share.alias("coverage"), "reparameterised")
    # one window can be lost at the edge of a copy, where the text around it changes its template
    thin = every.join(total, "item", "left").where((F.coalesce("windows", F.lit(0)) <= 1) | F.col("unspaced")).select("item", "words")
    thin = stage(thin, "thin")
    if not thin.isEmpty():
        found = found.unionByName(literal_leaks(docs, thin, doc_id, text, width, least))
        found = found.groupBy("k1", "k2", "doc_id", "item").agg(F.max("coverage").alias("coverage"), F.min("reparameterised").alias("reparameterised"))
    return found.join(names, "item").select("k1", "k2", "doc_id", "item_id", "coverage", "reparameterised")


def clean(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that no item contaminates; columns unchanged."""
    with noted() as tables:
        found = stage(leaks(docs, benchmark, doc_id, text).select("k1", "k2").distinct(), "leaks", gather=True)
    discard(*(t for t in tables if t is not found))
    some = F.broadcast(found) if found.count() <= BROADCAST_ROWS else found
    rows = packed(docs, i=doc_id, t=text).select(*keys(F.col("i"), F.col("t")), "row")
    return unpacked(rows.join(some, ["k1", "k2"], "left_anti"), docs.columns)
