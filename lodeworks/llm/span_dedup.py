"""Substring dedup by sliding sentence spans (operator 2).

A text is cut into sentences: behind ``. ! ?`` and the full stops of East Asian scripts, at line breaks, and before a capital letter, so a
passage set into other text is cut alike wherever it stands. A sentence of over ``LONG`` words is cut further before the words whose
hash says so (one in four), so a passage that begins or ends inside long sentences still has cuts in common
with its copies. In scripts without spaces each character is a word.

A run is a row of consecutive sentences: from each cut on the shortest with ``least_words`` words or more, and up to each sentence end
the shortest. A sentence of that length is a run by itself. Every run is hashed (lower-cased words; two polynomials over the
words' hashes, so all runs of a text come from its prefix sums) and meets its equals over all documents. Of equal runs the first by
(doc_id, place) stays; a sentence goes when any run over it is not the first of its kind.

Runs are counted by a 64-bit hash with a map-side combine, only those that repeat are dealt out with their places, under
96 bits. The join of a run with its first place is an equi-join that adaptive execution can split, so one run may be in a third
of the documents. Nothing is broadcast. Runs are made anew from the text for each of the two passes, which costs less than keeping them.

Defined cases: null and empty texts stay as they are; a text of fewer than ``least_words`` words has no run and stays.
Documents alike in id and text are one and share the outcome. A null doc_id comes after all others. All rows and columns
stay, whatever their names, but for a column ``sentences_removed``, which is replaced; a text with no sentence left is empty. No rows
in, no rows out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.llm.arrow import add_columns, mapped
from lodeworks.llm.rows import keys, named, packed, unpacked
from lodeworks.sources.shared import discard, stage

LEAST_WORDS, LONG = 36, 24
_CUT = regex.compile(r"(?<=[.!?])\s+|\n\s*|\s+(?=\p{Lu})")
# the same for ASCII texts, faster
_PLAIN_CUT = re.compile(r"(?<=[.!?])[ \t-\r]+|\n[ \t-\r]*|[ \t-\r]+(?=[A-Z])")
# scripts without spaces and their stops begin here; cheaper to ask for
_HIGH = re.compile("[\u0e00-\U0010ffff]")
_WIDE_STOP = regex.compile("[。！？｡]")
# slower, so only for texts that hold such a stop
_WIDE_CUT = regex.compile(rf"{_CUT.pattern}|{_WIDE_STOP.pattern}\s*")
_UNSPACED = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]")
#: Bases of the two polynomials: odd, so that they have inverses modulo 2^64.
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


class _Powers:
    """Powers of a base and of its inverse modulo 2^64, as many as asked for."""

    def __init__(self, base: int):
        self.up, self.down = np.array([1], np.uint64), np.array([1], np.uint64)
        self.bases = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            more = max(n, 4096) - 1
            self.up, self.down = (np.cumprod(np.concatenate(([np.uint64(1)], np.full(more, b, np.uint64))), dtype=np.uint64) for b in self.bases)
        return self.up[:n], self.down[:n]


_POWERS = [_Powers(b) for b in _BASES]


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of each sentence, white space behind it included; together they are the text."""
    cut = _PLAIN_CUT if text.isascii() else _WIDE_CUT if _HIGH.search(text) and _WIDE_STOP.search(text) else _CUT
    ends = [m.end() for m in cut.finditer(text)]
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    return list(zip([0, *ends], ends, strict=False))


def _words(text: str, spaced: bool) -> list[str]:
    return text.split() if spaced else _UNSPACED.sub(r" \g<0> ", text).split()


class Pieces:
    """A text's words and where it is cut."""

    def __init__(self, text: str):
        self.text = text
        plain = text.isascii()
        self.spaced = plain or not _HIGH.search(text) or not _UNSPACED.search(text) and not _WIDE_STOP.search(text)
        if self.spaced and "\0" not in text:
            words = (_PLAIN_CUT if plain else _CUT).sub(" \0 ", text).lower().split()
            marks = np.array([i for i, w in enumerate(words) if w == "\0"], np.int64)
            first = np.concatenate((np.zeros(1, np.int64), marks - np.arange(len(marks))))
            words = [w for w in words if w != "\0"]
        else:
            words, first = [], []
            for a, b in sentences(text):
                first.append(len(words))
                words += _words(text[a:b].lower(), self.spaced)
        n = len(words)
        self.hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
        first = np.asarray(first, np.int64)  # of each sentence its first word's number, in order; blank ones repeat the next one's
        mark = np.zeros(n + 1, bool)
        mark[first] = True
        mark[n] = True
        starts = np.flatnonzero(mark)
        self.sentence_ends = starts[1:]
        size = np.diff(starts)
        mark[:n] |= np.repeat(size > LONG, size) & (self.hashes & np.uint64(3) == 0)
        self.cuts = np.flatnonzero(mark)

    def runs(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """First words and word counts of the runs."""
        cuts = self.cuts
        if cuts[-1] < least:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.searchsorted(cuts, cuts[:-1] + least)
        forth = np.append(cuts, -1)[at]  # the end of the run from each cut on, -1 for none
        ends = self.sentence_ends[self.sentence_ends >= least]
        back = np.searchsorted(cuts, ends - least, "right") - 1
        new = forth[back] != ends
        on = forth >= 0
        start = np.concatenate((cuts[:-1][on], cuts[back[new]]))
        return start, np.concatenate((forth[on], ends[new])) - start

    def digests(self, start: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
        """Two 64-bit hashes of each run."""
        out = []
        for powers in _POWERS:
            up, down = powers.to(len(self.hashes))
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.hashes * up, dtype=np.uint64)))
            h = (total[start + size] - total[start]) * down[start] + size.astype(np.uint64)
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            out.append(h ^ h >> np.uint64(29))
        return out

    def without(self, gone: list[tuple[int, int]]) -> tuple[str, int]:
        """The text without the pieces under ``gone`` (first word, words), and how many went."""
        mark = np.zeros(self.cuts[-1] + 1, np.int64)
        for start, size in gone:
            mark[start] += 1
            mark[start + size] -= 1
        out = (np.cumsum(mark) > 0)[self.cuts[:-1]]
        begins, cuts, k = [], self.cuts[:-1].tolist(), 0
        for a, b in sentences(self.text):
            if len(begins) == len(cuts):
                break
            words, at, j = _words(self.text[a:b], self.spaced), a, 0
            while len(begins) < len(cuts) and cuts[len(begins)] < k + len(words):
                for word in words[j : cuts[len(begins)] - k]:
                    at = self.text.index(word, at) + len(word)
                j = cuts[len(begins)] - k
                begins.append(self.text.index(words[j], at) if j else a)
            k += len(words)
        begins[0] = 0  # white space before the first word
        kept = [self.text[a:b] for a, b, o in zip(begins, [*begins[1:], len(self.text)], out.tolist(), strict=True) if not o]
        return "".join(kept), int(out.sum())


def _spans(rows: DataFrame, places: bool, least: int) -> DataFrame:
    """h1 of each run of (t, i, k); with ``places`` also h2, i, at (the text's key and the first word) and size (words)."""
    kind = rows.schema["i"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 256):
                b = whole.slice(at, 256)
                key = b.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
                row, one, two, place, sizes = [], [], [], [], []
                for r, text in enumerate(b.column(0).to_pylist()):
                    p = Pieces(text)
                    start, size = p.runs(least)
                    if not len(start):
                        continue
                    h1, h2 = p.digests(start, size)
                    one.append(h1)
                    if places:
                        row.append(np.full(len(start), r))
                        two.append(h2)
                        place.append(key[r] << 32 | start)
                        sizes.append(size)
                if not one:
                    continue
                h1 = pa.array(np.concatenate(one).view(np.int64))
                if not places:
                    yield pa.RecordBatch.from_arrays([h1], names=["h1"])
                    continue
                h2 = pa.array((np.concatenate(two) >> np.uint64(32)).astype(np.uint32).view(np.int32))
                yield pa.RecordBatch.from_arrays([h1, h2, b.column(1).take(pa.array(np.concatenate(row))), pa.array(np.concatenate(place)), pa.array(np.concatenate(sizes).astype(np.int32))], names=["h1", "h2", "i", "at", "size"])

    return mapped(rows.select("t", "i", "k"), work, f"h1 long, h2 int, i {kind}, at long, size int" if places else "h1 long")


def _key(doc_id: Column, text: Column) -> Column:
    """Tells texts of one doc_id apart: 32 bits."""
    return F.shiftright(keys(doc_id, text)[1], 32).cast("int")


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST_WORDS) -> DataFrame:
    """(i, k, start, size, doc): runs that are not the first of their kind, by document row and word, and where the first is."""
    rows = docs.select(named(text).alias("t"), named(doc_id).alias("i"), _key(named(doc_id), named(text)).alias("k")).dropna(subset=["t"])
    again = stage(_spans(rows, False, least).groupBy("h1").count().where("count > 1").select("h1"), "spans", gather=True)
    # shuffled at every size: a broadcast would save most of it for a small corpus only
    spans = stage(_spans(rows, True, least).join(again.hint("merge"), "h1", "left_semi"), "places")
    discard(again)
    place = F.struct(F.col("i").isNull().alias("z"), "i", "at")
    # a table, so that what the join reads is dealt out for it alone and can be split
    first = stage(spans.groupBy("h1", "h2").agg(F.min(place).alias("first")), "first")
    later = spans.join(first, ["h1", "h2"]).where(place != F.col("first"))
    return later.select("i", F.shiftright("at", 32).cast("int").alias("k"), F.col("at").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("start"), "size", F.col("first.i").alias("doc"))


def remove(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST_WORDS) -> DataFrame:
    """All documents and columns, ``text`` without the sentences that go, and ``sentences_removed``."""
    gone = repeated_spans(docs, doc_id, text, least).groupBy(F.col("i").alias("gi"), F.col("k").alias("gk")).agg(F.collect_set(F.struct("start", "size")).alias("s"))
    rows = packed(docs, i=doc_id, t=text).withColumn("k", _key(F.col("i"), F.col("t")))
    rows = rows.join(gone, F.col("i").eqNullSafe(F.col("gi")) & (F.col("k") == F.col("gk")), "left").select(F.struct("t", "s").alias("both"), "row")

    def factory():
        def make(values: list) -> list[list]:
            done = [Pieces(v["t"]).without([(s["start"], s["size"]) for s in v["s"]]) if v["s"] else (v["t"], 0) for v in values]
            return list(map(list, zip(*done, strict=True)))

        return make

    made = add_columns(rows, "both", {"t": pa.string(), "n": pa.int64()}, factory)
    return unpacked(made, docs.columns, {text: F.col("t"), "sentences_removed": F.col("n")})
