"""Byte-level BPE by prefix dynamic programming (operator 6).

A rank file fixes for every byte string one token sequence. Of any prefix of a piece the sequence ends in one token,
and a prefix's sequence is the sequence of the prefix before that last token, and that token. So a piece is encoded
left to right by storing one token for each prefix: the token at whose end the prefix stands and that can follow the
last token of what is before it. Whether one token can follow another is a fact about the two alone: no merge of the
rank file crosses their border, going back through the merges that made them. The stored tokens allow exact appends and
re-encoding near an edit (:class:`PrefixEncoder`): tokens before an edit stay, tokens behind it are computed until as
many as the longest token agree with the former ones.

Texts are split by the tokenizer's pattern, each match is encoded by itself (a match that is a token is that token, as in the tiktoken library), without special tokens; letters, numbers
and white space are what the tiktoken library takes for them, whose Unicode version can be another. Pieces are
remembered in two tables of bounded size for each Python worker (not those longer than ``LONG`` characters); new ones are
encoded in byte order, each going on from the prefix it shares with the one before. Time is linear in a piece's length.

Defined cases: null and empty texts have no tokens (an empty binary). Whole texts are encoded. Repeated rows repeat,
extra columns go along, no rows give no rows. An id outside the vocabulary is an error in decoding.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.llm.arrow import add_columns

LONG, REMEMBERED, PAIRS, BLOCK = 64, 100_000, 250_000, 0x2000


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token to rank from the contents of a rank file."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


def load_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


class Vocabulary:
    """Ranks, the merge behind each token, and which token can follow which."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        self.tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.whole: set[int] = set()  # tokens that their own bytes are encoded to
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) == 1:
                self.whole.add(rank)
            elif halves := self._halves(token, rank):
                self.halves[rank] = halves
                self.merged[halves] = rank
                self.whole.add(rank)
        #: For each token what is known of the tokens before it: whether it can follow.
        self._known: list[dict[int, bool]] = [{} for _ in self.tokens]
        self._pairs = 0
        #: Tokens from their last byte back: byte to (the node behind it, the rank of the token that is complete, or -1).
        self.tails: dict[int, tuple[dict, int]] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: len(x[0])):
            node = self.tails
            for byte in token[:0:-1]:
                node = node.setdefault(byte, ({}, -1))[0]
            node[token[0]] = (node.get(token[0], ({}, -1))[0], rank)

    def extend(self, data: bytes, last: list[int]) -> None:
        """Append the last token of each prefix of ``data`` that ``last`` doesn't hold yet; the empty one's is -1."""
        known, tails, whole, follows = self._known, self.tails, self.whole, self.follows
        for end in range(len(last), len(data) + 1):
            at, node, fits = end, tails, False
            while at and not fits:
                at -= 1
                step = node.get(data[at])
                if step is None:
                    raise ValueError("a byte has no token")
                node, t = step
                if t >= 0:
                    if at:
                        fits = known[t].get(last[at])
                        if fits is None:
                            fits = follows(last[at], t)
                    else:
                        fits = t in whole
            if not fits:
                raise ValueError("a byte has no token")
            last.append(t)

    def walk(self, data: bytes, last: list[int]) -> list[int]:
        """The tokens, from the stored last tokens."""
        out, end, tokens = [], len(data), self.tokens
        while end:
            out.append(t := last[end])
            end -= len(tokens[t])
        return out[::-1]

    def encode_sorted(self, pieces: list[bytes]) -> Iterator[list[int]]:
        """Encode pieces in byte order: each goes on from the prefix it shares with the one before."""
        last, before = [-1], b""
        for data in pieces:
            if (whole := self.ranks.get(data)) is not None:
                # a piece that is a token is that token, even if no merges lead to it
                yield [whole]
                continue
            same, most = 0, min(len(data), len(before))
            while same < most and data[same] == before[same]:
                same += 1
            del last[same + 1 :]
            self.extend(data, last)
            before = data
            yield self.walk(data, last)

    def _halves(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The two tokens that the last merge joins; none if lower merges don't lead to two."""
        parts = [self.ranks[token[i : i + 1]] for i in range(len(token))]
        while len(parts) > 2:
            best, at = rank, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(self.tokens[parts[i]] + self.tokens[parts[i + 1]], rank)
                if r < best:
                    best, at = r, i
            if at < 0:
                return None
            parts[at : at + 2] = [best]
        return parts[0], parts[1]

    def follows(self, a: int, b: int) -> bool:
        """Whether a then b is how their joined bytes are encoded."""
        known = self._known[b].get(a)
        if known is None:
            if self._pairs >= PAIRS:
                self.forget()
            known = self._known[b][a] = self._follows(a, b)
            self._pairs += 1
        return known

    def forget(self) -> None:
        for row in self._known:
            row.clear()
        self._pairs = 0

    def _follows(self, a: int, b: int) -> bool:
        # Undo merges, the later one first; a merge across the border that comes before the one just undone forbids the pair.
        if b not in self.whole:
            return False  # no merges make it
        bound = len(self.tokens)
        halves, merged = self.halves, self.merged
        while True:
            if merged.get((a, b), bound) < bound:
                return False
            if a > b and a in halves or b not in halves and a in halves:
                bound, a = a, halves[a][1]
            elif b in halves:
                # of equal rank the left one is merged first
                bound, b = b + 1, halves[b][0]
            else:
                return True


class PrefixEncoder:
    """The encoding of a byte string that can be appended to and edited."""

    def __init__(self, vocabulary: Vocabulary, piece: bytes = b""):
        self.v, self.data, self.last = vocabulary, b"", [-1]
        self.append(piece)

    def append(self, more: bytes) -> None:
        self.data += more
        self.v.extend(self.data, self.last)

    def edit(self, start: int, stop: int, new: bytes) -> int:
        """Replace bytes [start, stop); returns how many prefixes were computed anew."""
        former, shift, size = self.last, start + len(new) - stop, len(self.data)
        self.data = self.data[:start] + new + self.data[stop:]
        self.last = former[: start + 1]
        agreed = 0
        for end in range(start + 1, len(self.data) + 1):
            self.v.extend(self.data[:end], self.last)
            before = end - shift
            agreed = agreed + 1 if before > stop and former[before] == self.last[end] else 0
            if agreed >= self.v.longest and before < size:
                self.last.extend(former[before + 1 :])
                return end - start
        return len(self.data) - start

    def ids(self) -> list[int]:
        whole = self.v.ranks.get(self.data)
        return self.v.walk(self.data, self.last) if whole is None else [whole]


def stand_ins() -> dict[int, str]:
    """Code points of which the tiktoken library, of another Unicode version, thinks otherwise: to a character of the class it takes them for."""
    single, out = {bytes([i]): i for i in range(256)}, {}
    for kind, sample in ((r"\p{L}", "\u00aa"), (r"\p{N}", "\u00b2"), (r"\s", "\u00a0")):
        library = tiktoken.Encoding("class", pat_str=kind, mergeable_ranks=single, special_tokens={})
        for start in range(0, 0x110000, BLOCK):  # a block at a time, as each worker makes this table
            some = "".join(chr(c) for c in range(start, start + BLOCK) if not 0xD800 <= c < 0xE000)
            theirs, ours = set(bytes(library.encode_ordinary(some)).decode()), set(regex.findall(kind, some))
            out |= {ord(c): out.get(ord(c), "\uffff") for c in ours - theirs} | {ord(c): sample for c in theirs - ours}
    return out


class Codec:
    """Encodes and decodes texts; ``pieces`` and ``former`` hold the packed ids of recent pieces."""

    def __init__(self, rank_file: bytes, pattern: str):
        self.v = Vocabulary(read_ranks(rank_file))
        self.pattern = regex.compile(pattern)
        self.stand_ins = stand_ins()
        self.odd = frozenset(map(chr, self.stand_ins))
        self.pieces: dict[str, bytes] = {}
        self.former: dict[str, bytes] = {}

    def split(self, text: str) -> list[str]:
        if text.isascii() or self.odd.isdisjoint(text):
            return self.pattern.findall(text)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(text.translate(self.stand_ins))]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        split = [self.split(t) if t else () for t in texts]
        every = set().union(*split)
        if len(self.pieces) >= REMEMBERED:
            # what is in use goes on to the next table, what isn't met again goes with the one before
            self.former, self.pieces = self.pieces, {}
        known, extra = self.pieces, []
        if self.former:
            known.update((p, self.former[p]) for p in every.difference(known).intersection(self.former))
        missing = sorted((p.encode(), p) for p in every.difference(known))
        for (_, piece), ids in zip(missing, self.v.encode_sorted([d for d, _ in missing]), strict=True):
            known[piece] = struct.pack(f"<{len(ids)}I", *ids)
            if len(piece) > LONG:
                extra.append(piece)
        out = [b"".join(map(known.__getitem__, s)) for s in split]
        for piece in extra:
            del known[piece]
        return out

    def forget(self) -> None:
        self.pieces, self.former = {}, {}
        self.v.forget()

    def decode(self, ids: list[bytes | None]) -> list[bytes]:
        token = self.v.tokens.__getitem__
        return [b"".join(map(token, np.frombuffer(x, "<u4").tolist())) if x else b"" for x in ids]


_CODECS: dict[int, Codec] = {}


def _codec(rank_file: bytes, pattern: str) -> Codec:
    """One codec for each Python worker and vocabulary."""
    key = hash((rank_file, pattern))
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(rank_file, pattern)
    return _CODECS[key]


def _mapped(docs: DataFrame, source: str, to: list[str], rank_file: bytes, pattern: str, make: Callable[[Codec, list], list[list]]) -> DataFrame:
    shipped = docs.sparkSession.sparkContext.broadcast(rank_file)

    def factory() -> Callable[[list], list[list]]:
        codec = _codec(shipped.value, pattern)

        def run(values: list) -> list[list]:
            return make(codec, values)

        run.finish = codec.forget
        return run

    return add_columns(docs, source, dict.fromkeys(to, pa.binary()), factory)


def encode(docs: DataFrame, rank_file: bytes, pattern: str, text: str = "text", to: str = "ids") -> DataFrame:
    """Add ``to``: the ids of the whole text, little-endian unsigned 32-bit integers."""
    return _mapped(docs, text, [to], rank_file, pattern, lambda codec, texts: [codec.encode(texts)])


def decode(tokens: DataFrame, rank_file: bytes, pattern: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """Add ``to``: the bytes that the ids stand for."""
    return _mapped(tokens, ids, [to], rank_file, pattern, lambda codec, packed: [codec.decode(packed)])


def encode_and_decode(docs: DataFrame, rank_file: bytes, pattern: str, text: str = "text", to: tuple[str, str] = ("ids", "decoded")) -> DataFrame:
    """Both columns, the second made of the first; a task has one Python worker with one codec for both, not two."""

    def make(codec: Codec, texts: list) -> list[list]:
        ids = codec.encode(texts)
        return [ids, codec.decode(ids)]

    return _mapped(docs, text, list(to), rank_file, pattern, make)


def digests(docs: DataFrame, rank_file: bytes, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of an encoding and its decoding."""
    both = encode_and_decode(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), rank_file, pattern)
    return both.select(
        "doc_id",
        F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
