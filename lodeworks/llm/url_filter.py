"""URL filters by the ratio of two character language models (operator 8).

Rules (host, path, verdict) decide what they fit; the URLs they decide are the labelled rows, without the characters that
the rule itself names. Two smoothed variable-order Markov models, of accepted and of rejected URLs, judge the rest: the
log-likelihood difference for each character against a threshold calibrated on a fifth of the labelled rows that the models don't see.

A model holds counts of characters behind contexts of up to ``order`` characters; each order is interpolated with the
next shorter one by Witten-Bell weights, down to a flat distribution over the alphabet seen and one unseen character.

Nothing is sampled. The distinct labelled URLs are put in order of their hash, each fifth of a verdict is held out, all others are
learned from; the models are tables of counts, and what each run of characters adds to a score is looked up by joins. The
threshold comes from the scores of all held-out rows, by running sums over them. To the driver go two counts and the best cut.
:class:`Markov`, :func:`fit` and :func:`calibrate` are the same for lists of texts.

Defined cases: a null URL or one without ``://`` has an empty host and path, fits no rule and scores 0; it is allowed
where the threshold is 0 or less. Without labelled rows of one verdict there is no model, and what no rule fits is
allowed, score 0. Long URLs are read whole. Repeated rows repeat, extra columns go along, whatever their names, but for
those called as an output, which are replaced.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import log
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.llm.arrow import mapped
from lodeworks.llm.rows import LOWER, UPPER, packed, unpacked
from lodeworks.sources.shared import discard, noted, stage

ALLOW, BLOCK = "allow", "block"
MARK = "\x03"
HOLD_OUT, ROWS_OUT = 5, 50_000


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``, null where there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(after_scheme(url), "^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def first_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """struct(rule, verdict, in_host, in_path) of the longest rule that fits (its characters in host and path), null if none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string,in_host:int,in_path:int>")
    for r in sorted(rules, key=lambda r: len(r.host + r.path)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        what = F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"), F.lit(len(r.host)).alias("in_host"), F.lit(len(r.path)).alias("in_path"))
        found = F.when(fits, what).otherwise(found)
    return found


def beside_rule(text: Column, host: Column, path: Column, rule: Column) -> Column:
    """What is left of a URL's text without what its rule names, a mark in its place: the models are to learn what else tells
    the two kinds apart, as they judge URLs that no rule fits."""
    ahead = F.substring(host, F.lit(1), F.length(host) - rule["in_host"])
    behind = F.substring(path, rule["in_path"] + 1, F.length(path))
    rest = F.substring(text, F.length(host) + F.length(path) + 1, F.length(text))
    return F.translate(F.concat(ahead, F.lit(MARK), behind, rest), UPPER, LOWER)


@dataclass
class Markov:
    """Counts of characters behind contexts, and their interpolation."""

    order: int = 5
    after: dict[str, dict[str, int]] = field(default_factory=dict)
    alphabet: set[str] = field(default_factory=set)
    known: dict[tuple[str, str], float] = field(default_factory=dict)

    def learn(self, text: str) -> None:
        text = "\x02" * self.order + text
        for i in range(self.order, len(text)):
            self.alphabet.add(text[i])
            for n in range(self.order + 1):
                seen = self.after.setdefault(text[i - n : i], {})
                seen[text[i]] = seen.get(text[i], 0) + 1

    def prob(self, context: str, char: str) -> float:
        p = self.known.get((context, char))
        if p is None:
            lower = self.prob(context[1:], char) if context else 1 / (len(self.alphabet) + 1)
            if seen := self.after.get(context):
                total, kinds = sum(seen.values()), len(seen)
                p = (seen.get(char, 0) + kinds * lower) / (total + kinds)
            else:
                p = lower
            if len(self.known) > 500_000:
                self.known.clear()
            self.known[context, char] = p
        return p

    def log_likelihood(self, text: str) -> float:
        text = "\x02" * self.order + text
        return sum(log(self.prob(text[i - self.order : i], text[i])) for i in range(self.order, len(text)))


@dataclass
class Ratio:
    accepted: Markov
    rejected: Markov
    threshold: float = 0.0

    def score(self, text: str | None) -> float:
        return (self.accepted.log_likelihood(text) - self.rejected.log_likelihood(text)) / len(text) if text else 0.0


def calibrate(good: list[float], bad: list[float]) -> float:
    """The threshold with the best balanced accuracy; the middle of the widest best interval, 0 without rows."""
    if not good or not bad:
        return 0.0
    marks = sorted({*good, *bad})
    cuts = [marks[0] - 1, *((a + b) / 2 for a, b in zip(marks, marks[1:], strict=False)), marks[-1] + 1]
    good, bad = sorted(good), sorted(bad)
    hits = lambda c: (len(good) - bisect_left(good, c)) / len(good) + bisect_left(bad, c) / len(bad)
    best = max(map(hits, cuts))
    fine = [c for c in cuts if hits(c) == best]
    return min(fine, key=abs)


def fit(accepted: list[str], rejected: list[str], order: int = 5, hold_out: int = 5) -> Ratio | None:
    """Models of all but each ``hold_out``-th text, the threshold from those."""
    if not accepted or not rejected:
        return None
    ratio = Ratio(Markov(order), Markov(order))
    kept: list[list[str]] = [[], []]
    for side, (model, texts) in enumerate(((ratio.accepted, accepted), (ratio.rejected, rejected))):
        for i, text in enumerate(texts):
            if i % hold_out == hold_out - 1:
                kept[side].append(text)
            else:
                model.learn(text)
    good, bad = ([ratio.score(t) for t in texts] for texts in kept)
    ratio.threshold = calibrate(good, bad)
    ratio.accepted.known, ratio.rejected.known = {}, {}
    return ratio


def labelled_texts(texts: DataFrame) -> DataFrame:
    """(side, text, held) of distinct texts (side, text): each ``HOLD_OUT``-th of a side, in order of the hash, is held out.

    Places are counted in buckets of the hash, behind the sizes of the buckets before.
    """
    rows = texts.withColumn("h", F.xxhash64("text")).withColumn("bucket", F.shiftright("h", 52))
    size = rows.groupBy("side", "bucket").agg(F.count("*").alias("n"))  # 4,096 of a side at most
    before = Window.partitionBy("side").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ahead = size.select("side", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    place = F.row_number().over(Window.partitionBy("side", "bucket").orderBy("h", "text")) + F.col("ahead")
    return rows.join(ahead, ["side", "bucket"]).select("side", "text", (place % HOLD_OUT == 0).alias("held"))


def grams(texts: DataFrame, order: int) -> DataFrame:
    """The columns of ``texts`` before the last one, gram and n: how often each run of ``order`` + 1 characters is in the text, the
    last column, with ``order`` marks ahead. Texts of a batch that are alike in the other columns are counted together."""
    by = len(texts.columns) - 1

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held: dict[tuple, Counter] = {}
            for *key, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                padded = "\x02" * order + text
                held.setdefault(tuple(key), Counter()).update(padded[i : i + order + 1] for i in range(len(text)))
            rows = [(*key, gram, n) for key, counts in held.items() for gram, n in counts.items()]
            for at in range(0, len(rows), ROWS_OUT):
                values = zip(*rows[at : at + ROWS_OUT], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, [*(c.type for c in b.columns[:by]), pa.string(), pa.int64()], strict=True)], names=names)

    names = [*texts.columns[:by], "gram", "n"]
    kinds = [texts.schema[c].dataType.simpleString() for c in texts.columns[:by]]
    return mapped(texts, read, ", ".join(f"{c} {k}" for c, k in zip(names, [*kinds, "string", "long"], strict=True)))


def _ends(gram: Column, order: int) -> Column:
    """The last characters of a gram, from one to all."""
    return F.array(*(F.substring(gram, order + 1 - n, n + 1) for n in range(order + 1)))


def gains(learned: DataFrame, wanted: DataFrame, order: int) -> DataFrame:
    """(gram, gain): log-likelihood of the last character of the ``wanted`` grams behind the others by the model of accepted texts, less
    that by the model of rejected ones. learned: (side, gram, n)."""
    of = lambda side: F.sum(F.when(F.col("side") == side, F.col("n")).otherwise(0))
    whole = learned.groupBy("gram").agg(of(ALLOW).alias("a"), of(BLOCK).alias("b"))
    known = stage(whole.select(F.explode(_ends(F.col("gram"), order)).alias("end"), "a", "b").groupBy("end").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), "counts", gather=True)
    context = lambda c: F.substring(c, F.lit(1), F.length(c) - 1)
    kinds = lambda c: F.count(F.when(F.col(c) > 0, 1))
    behind = known.groupBy(context(F.col("end")).alias("context")).agg(F.sum("a").alias("ta"), kinds("a").alias("ka"), F.sum("b").alias("tb"), kinds("b").alias("kb"))
    spelled = wanted.select("gram", F.posexplode(_ends(F.col("gram"), order)).alias("k", "end"))
    # what is known of each end is looked up once, so no end or context that many grams share meets them all
    ends = spelled.select("end").distinct().join(known, "end", "left").withColumn("context", context(F.col("end"))).join(behind, "context", "left")
    facts = stage(ends.select("end", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("a", "ta", "ka", "b", "tb", "kb"))), "ends", gather=True)
    each = spelled.join(facts, "end").groupBy("gram").agg(F.sort_array(F.collect_list(F.struct("k", "a", "ta", "ka", "b", "tb", "kb"))).alias("e"))

    def chance(c: str, t: str, k: str) -> Column:
        start = F.lit(1.0) / (F.col("e")[0][k] + 1)
        return F.aggregate("e", start, lambda p, x: F.when(x[t] > 0, (x[c] + x[k] * p) / (x[t] + x[k])).otherwise(p))

    return each.select("gram", (F.log(chance("a", "ta", "ka")) - F.log(chance("b", "tb", "kb"))).alias("gain"))


def best_cut(rows: DataFrame) -> float:
    """:func:`calibrate` for rows (side, score)."""
    of = lambda side: F.count(F.when(F.col("side") == side, 1))
    marks = stage(rows.groupBy("score").agg(of(ALLOW).alias("a"), of(BLOCK).alias("b")).withColumn("bucket", F.floor(F.col("score") * 64)), "marks", gather=True)
    size = marks.groupBy("bucket").agg(F.sum("a").alias("sa"), F.sum("b").alias("sb"), F.min("score").alias("least"))  # few: a score is a mean of logarithms
    all_a, all_b, least = size.agg(F.sum("sa"), F.sum("sb"), F.min("least")).first()
    if not all_a or not all_b:
        return 0.0
    along = Window.orderBy("bucket")
    before = lambda c: F.coalesce(F.sum(c).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ahead = size.select("bucket", before("sa").alias("sa"), before("sb").alias("sb"), F.lead("least").over(along).alias("after"))
    inside = Window.partitionBy("bucket").orderBy("score")
    upto = lambda c, s: F.sum(c).over(inside.rowsBetween(Window.unboundedPreceding, 0)) + F.col(s)
    each = marks.join(ahead, "bucket").select("score", upto("a", "sa").alias("a"), upto("b", "sb").alias("b"), F.coalesce(F.lead("score").over(inside), "after").alias("next"))
    hits = (F.lit(all_a) - F.col("a")) / F.lit(all_a) + F.col("b") / F.lit(all_b)
    cuts = each.select(hits.alias("hits"), F.coalesce((F.col("score") + F.col("next")) / 2, F.col("score") + 1).alias("cut"))
    best = cuts.orderBy(F.desc("hits"), F.abs("cut"), "cut").first()
    return min((-1.0, abs(least - 1), least - 1), (-best.hits, abs(best.cut), best.cut))[2]


def judge(pages: DataFrame, rules: list[Rule], url: str = "url", order: int = 5) -> DataFrame:
    """Add host, path, rule, verdict and url_score (log-likelihood difference a character); columns so called are replaced."""
    parted = packed(pages, u=url).withColumns({"host": host_of(F.col("u")), "path": path_of(F.col("u")), "after": F.coalesce(after_scheme(F.col("u")), F.lit(""))})
    parted = parted.withColumns({"text": F.translate("after", UPPER, LOWER), "rule": first_rule(F.col("host"), F.col("path"), rules)})
    parted = parted.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(1), "text")})
    with noted() as tables:
        rest = beside_rule(F.col("after"), F.col("host"), F.col("path"), F.col("rule"))
        labelled = stage(labelled_texts(parted.where("rule is not null").select(F.col("rule.verdict").alias("side"), rest.alias("text")).where(F.col("text") != MARK).distinct()), "labelled", gather=True)
        threshold, scores = 0.0, None
        if labelled.select("side").distinct().count() == 2:
            held = labelled.where("held").select("side", "text", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))
            judged = parted.where("text <> ''").select("h1", "h2", "text").union(held.select("h1", "h2", "text")).distinct()
            spelled = stage(grams(judged.select("h1", "h2", F.length("text").alias("size"), "text"), order), "spelled")
            table = stage(gains(grams(labelled.where("not held").select("side", "text"), order), spelled.select("gram").distinct(), order), "gains", gather=True)
            # decimals: the sum doesn't depend on the order of its terms
            total = F.sum(F.col("n").cast("decimal(12,0)") * F.col("gain").cast("decimal(18,15)"))
            scores = spelled.join(table, "gram").groupBy("h1", "h2").agg((total.cast("double") / F.first("size")).alias("score"))
            scores = stage(scores, "scores", gather=True)
            threshold = best_cut(held.join(scores, ["h1", "h2"]).select("side", "score"))
    discard(*(t for t in tables if t is not scores))
    score = F.lit(0.0)
    if scores:
        parted, score = parted.join(scores, ["h1", "h2"], "left"), F.coalesce("score", F.lit(0.0))
    parted = parted.withColumn("url_score", score)
    by_method = F.when(F.col("url_score") >= F.lit(threshold), ALLOW).otherwise(BLOCK)
    return unpacked(parted, pages.columns, {"host": F.col("host"), "path": F.col("path"), "rule": F.col("rule.rule"), "verdict": F.coalesce(F.col("rule.verdict"), by_method), "url_score": F.col("url_score")})
