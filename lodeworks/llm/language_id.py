"""Language identification by segmentation-marginalised unigrams (operator 5).

Each language has a probability for every piece of a fixed public vocabulary. The probability of a word is the sum,
over all ways to cut its bytes into pieces, of the product of their probabilities; a forward pass over the bytes gives
that sum without listing the ways. A text's score under a language is the sum of its words' log-probabilities, each
occurrence counted, over the whole text; the prediction is the language of the highest, its score the posterior
probability under a flat prior.

Pieces: the vocabulary's lower-case letter strings, with or without the space before a word, and the single bytes, so
every word can be cut. A word is a run of letters and marks, lower-cased, with a space before it. Words of up to ``SHORT`` bytes go
through the forward pass many at a time, longer ones (a line without spaces) one by one in logarithms: the same sum, whole.

Fitting: expectation-maximisation (forward-backward) on a bounded sample: for each language the ``per_language`` rows
with the smallest hash of doc_id among the labelled rows, whole texts; their words are counted on the executors. A share of the mass is smoothed by the pooled and the
flat distribution. The model (pieces x languages) is of fixed size and is broadcast; word scores are remembered in a
table of bounded size for each Python worker. Language, source and doc_id are no inputs of a prediction.

Defined cases: null text or one without a letter: ``und``, score 0. A null doc_id is not learned from and not held out.
Ties go to the language first in order. Without labelled rows every text is ``und``. Repeated rows repeat. Other
columns go along; columns called as the two outputs are replaced. No rows in, no rows out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.llm.arrow import add_columns, give_back, mapped
from lodeworks.llm.byte_bpe import read_ranks
from lodeworks.llm.rows import named, packed, unpacked

SHORT, REMEMBERED = 32, 150_000
UND = "und"
_WORDS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def pieces_of(rank_file: bytes) -> list[bytes]:
    """The vocabulary's pieces that a lower-case word can hold, and all single bytes."""
    found = {bytes([i]) for i in range(1, 256)}
    for token in read_ranks(rank_file):
        try:
            word = token.decode().removeprefix(" ")
        except UnicodeDecodeError:
            continue
        if len(token) > 1 and word and word == word.lower() and _WORDS.fullmatch(word):
            found.add(token)
    return sorted(found)


def _spans(rows: np.ndarray, keys: np.ndarray, order: np.ndarray, longest: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(start, end, piece numbers) of every span that can be a piece; len(keys) stands for none. keys: sorted, order: their pieces."""
    size, wide = rows.shape[1], rows.astype(np.uint64) + np.uint64(1)
    for end in range(1, size + 1):
        key = np.zeros(len(rows), np.uint64)
        for start in range(end - 1, max(-1, end - 1 - longest), -1):
            key = key * _BASE + wide[:, start]
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            yield start, end, np.where(keys[at] == key, order[at], len(keys))


def _by_length(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions in ``words``, byte rows) of equal length."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(sizes):
        for part in np.array_split(at := np.flatnonzero(sizes == n), len(at) // 20_000 + 1):
            yield part, np.frombuffer(b"".join(words[i] for i in part), np.uint8).reshape(-1, n)


class Model:
    """Piece probabilities (pieces and a row of zeros x languages) and the sums over segmentations that they give."""

    def __init__(self, languages: list[str], pieces: list[bytes], prob: np.ndarray):
        self.languages, self.pieces, self.prob = languages, pieces, prob
        self.longest = max(map(len, pieces))
        keys = np.zeros(len(pieces), np.uint64)
        for i, p in enumerate(pieces):
            k = 0
            for byte in reversed(p):
                k = (k * int(_BASE) + byte + 1) % 2**64
            keys[i] = k
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces have one key")

    @cached_property
    def number(self) -> dict[bytes, int]:
        return {p: i for i, p in enumerate(self.pieces)}

    def spans(self, rows: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        return _spans(rows, self.keys, self.order, self.longest)

    def forward(self, rows: np.ndarray, prob: np.ndarray) -> list[np.ndarray]:
        """For each prefix length the summed probability of its segmentations, words x languages; words of ``SHORT`` bytes at most."""
        alpha = [np.ones((len(rows), prob.shape[1]))] + [np.zeros((len(rows), prob.shape[1])) for _ in range(rows.shape[1])]
        for start, end, piece in self.spans(rows):
            alpha[end] += alpha[start] * prob[piece]
        return alpha

    def long_spans(self, word: bytes, logs: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each end the starts and the pieces' log-probabilities."""
        get, out = self.number.get, []
        for end in range(1, len(word) + 1):
            found = [(start, n) for start in range(max(0, end - self.longest), end) if (n := get(word[start:end])) is not None]
            out.append((np.array([f[0] for f in found]), logs[[f[1] for f in found]]))
        return out

    def long_forward(self, word: bytes, logs: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """The same in logarithms for one word of any length, and its spans."""
        spans = self.long_spans(word, logs)
        alpha = np.zeros((len(word) + 1, logs.shape[1]))
        for end, (starts, p) in enumerate(spans, 1):
            alpha[end] = np.logaddexp.reduce(alpha[starts] + p, axis=0)
        return alpha, spans

    def log_prob(self, words: list[bytes]) -> np.ndarray:
        """Log-probability of each word under each language, all segmentations summed."""
        out = np.empty((len(words), len(self.languages)))
        short = [i for i, w in enumerate(words) if len(w) <= SHORT]
        for at, rows in _by_length([words[i] for i in short]):
            out[np.array(short)[at]] = np.log(self.forward(rows, self.prob)[-1])
        if len(short) < len(words):
            with np.errstate(divide="ignore"):
                logs = np.log(self.prob)
            for i, w in enumerate(words):
                if len(w) > SHORT:
                    out[i] = self.long_forward(w, logs)[0][-1]
        return out

    def expect(self, words: list[bytes], times: np.ndarray, p: np.ndarray) -> np.ndarray:
        """How often each piece is used in ``words``, expected over all segmentations; p: the probabilities of one language."""
        size = len(self.pieces)
        expected = np.zeros(size + 1)
        short = np.array([len(w) <= SHORT for w in words], bool)
        for at, rows in _by_length([w for w, s in zip(words, short, strict=True) if s]):
            alpha = self.forward(rows, p)
            beta = [np.zeros(len(rows)) for _ in alpha[:-1]] + [np.ones(len(rows))]
            spans = list(self.spans(rows))
            for start, end, piece in sorted(spans, key=lambda s: -s[0]):
                beta[start] += beta[end] * p[piece, 0]
            for start, end, piece in spans:
                share = alpha[start][:, 0] * p[piece, 0] * beta[end] / alpha[-1][:, 0] * times[short][at]
                expected += np.bincount(piece, share, size + 1)
        with np.errstate(divide="ignore"):
            logs = np.log(p)
        for i in np.flatnonzero(~short):
            word, n = words[i], times[i]
            alpha, spans = self.long_forward(word, logs)
            beta = np.full(len(word) + 1, -np.inf)
            beta[-1] = 0
            for end in range(len(word), 0, -1):
                starts, q = spans[end - 1]
                beta[starts] = np.logaddexp(beta[starts], beta[end] + q[:, 0])
            for end in range(1, len(word) + 1):
                starts, q = spans[end - 1]
                share = np.exp(alpha[starts, 0] + q[:, 0] + beta[end] - alpha[-1, 0]) * n
                np.add.at(expected, [self.number[word[s:end]] for s in starts.tolist()], share)
        return expected[:size]


def fit(counts: dict[str, dict[str, int]], rank_file: bytes, rounds: int = 2, smooth: float = 1e-3) -> Model:
    """Piece probabilities of each language from its word counts."""
    pieces, languages = pieces_of(rank_file), sorted(counts)
    size = len(pieces)
    model = Model(languages, pieces, np.zeros((size + 1, len(languages))))
    tables = [([spelled(w) for w in counts[k]], np.fromiter(counts[k].values(), float, len(counts[k]))) for k in languages]
    for turn in range(rounds + 1):
        flat = np.append(np.full(size, 1 / size), 0)[:, None]
        expected = np.stack([model.expect(words, times, flat if turn == 0 else model.prob[:, k : k + 1]) for k, (words, times) in enumerate(tables)], axis=1)
        expected /= np.maximum(expected.sum(axis=0), 1e-9)
        pooled = expected.mean(axis=1, keepdims=True)
        model.prob[:size] = (1 - smooth) * expected + smooth * (0.5 * pooled + 0.5 / size)
    return model


def spelled(word: str) -> bytes:
    """A word's bytes, the space before it included."""
    return b" " + word.encode()


def words_of(text: str | None) -> list[str]:
    return _WORDS.findall(text.lower()) if text else []


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text leaves 2, divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, rank_file: bytes, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 200) -> Model | None:
    """A model fitted on at most ``per_language`` whole texts of each language."""
    of = docs.select(F.col(doc_id).alias("i"), F.col(lang).alias("l"), F.col(text).alias("t")).where("i is not null and l is not null and t is not null")
    of = of.where(~held_out(F.col("i")))
    first = Window.partitionBy("l").orderBy(F.xxhash64("i"), "i")
    chosen = of.select("i", "l").withColumn("r", F.row_number().over(first)).where(F.col("r") <= per_language).select("i", "l").distinct()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = Counter((k, w) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for w in words_of(t))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.string()), pa.array([w for _, w in found], pa.string()), pa.array(list(found.values()), pa.int64())], names=["l", "w", "n"])

    counted = mapped(of.join(F.broadcast(chosen), ["i", "l"]).select(F.col("l").cast("string").alias("l"), "t"), count, "l string, w string, n long").groupBy("l", "w").agg(F.sum("n").alias("n"))
    counts: dict[str, dict[str, int]] = {}
    for row in counted.orderBy("l", "w").toLocalIterator():  # the distinct words of per_language rows a language
        counts.setdefault(row.l, {})[row.w] = row.n
    model = fit(counts, rank_file) if counts else None
    give_back()
    return model


class Scorer:
    def __init__(self, model: Model):
        self.model, self.row, self.table = model, {}, np.empty((0, len(model.languages)))

    def score(self, texts: list[str | None]) -> Iterator[tuple[str, float]]:
        bags = [Counter(words_of(t)) for t in texts]
        if len(self.row) > REMEMBERED:
            self.row, self.table = {}, self.table[:0]
        if fresh := sorted(set().union(*bags).difference(self.row)):
            self.row.update(zip(fresh, range(len(self.table), len(self.table) + len(fresh)), strict=True))
            self.table = np.concatenate((self.table, self.model.log_prob([spelled(w) for w in fresh])))
        for bag in bags:
            if not bag:
                yield UND, 0.0
                continue
            at = np.fromiter(map(self.row.__getitem__, bag), np.int64, len(bag))
            total = np.fromiter(bag.values(), float, len(bag)) @ self.table[at]
            best = int(total.argmax())
            yield self.model.languages[best], float(1 / np.exp(total - total[best]).sum())


def predict(docs: DataFrame, model: Model | None, text: str = "text", to: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Add the language and its score (columns ``to``, replaced where present), from the text alone."""
    if model is None:
        return docs.withColumns({to[0]: F.lit(UND), to[1]: F.lit(0.0)})
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def factory() -> Callable[[list], list[list]]:
        scorer = Scorer(shipped.value)
        return lambda texts: list(zip(*scorer.score(texts), strict=True))

    return add_columns(docs, text, {to[0]: pa.string(), to[1]: pa.float64()}, factory)


def accepted(docs: DataFrame, model: Model | None, text: str = "text", least: float = 0.5) -> DataFrame:
    """The documents with a language whose posterior is ``least`` or more; columns unchanged."""
    return unpacked(predict(packed(docs, t=text), model, "t", ("said", "score")).where((F.col("said") != UND) & (F.col("score") >= least)), docs.columns)
