import base64
import hashlib
import random
import struct

import public_tokenizers
import pytest
import tiktoken
from lodeworks.llm import byte_bpe, registry
from lodeworks.sources.tables import table
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, ids int, decoded int, `a.b` int"
RANKS = byte_bpe.load_ranks(registry.BPE_RANKS)
BOUNDS = "a'tb  \n\t x\u00e9\u0301\u4e2d\U0001f600\u00a0\u2028\u0663\u00bd_-9"


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("r", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


def want(reference, text):
    ids = reference.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_query_as_the_library(spark, sf_dir, reference):
    texts = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in registry.op6_byte_bpe(spark, sf_dir).collect()}
    assert got == {i: want(reference, t) for i, t in texts.items()}


def test_odd_texts_as_the_library(reference):
    r = random.Random(7)
    texts = ["", "don't stop", "\x00\x01", "<|endoftext|>", " " * 3000, "ab" * 2000, "\u0130\u00df\ufb01 \u2003x", "1234567890 " * 50]
    texts += ["".join(r.choices(BOUNDS, k=r.randint(1, 60))) for _ in range(600)]
    texts += ["".join(chr(c) for c in (r.randrange(0x110000) for _ in range(30)) if not 0xD800 <= c < 0xE000) for _ in range(300)]
    codec = byte_bpe.Codec(RANKS, public_tokenizers.PATTERN)
    coded = codec.encode(texts)
    for text, ids in zip(texts, coded, strict=True):
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == reference.encode_ordinary(text), repr(text)
    assert codec.decode(coded) == [t.encode() for t in texts]


def test_appends_and_edits(reference):
    r, v = random.Random(8), byte_bpe.Vocabulary(byte_bpe.read_ranks(RANKS))
    data = " ".join("".join(r.choices("etaoinshr", k=r.randint(1, 9))) for _ in range(400)).encode()
    e = byte_bpe.PrefixEncoder(v, data[:50])
    e.append(data[50:])
    assert e.ids() == reference._encode_single_piece(data)
    far = 0
    for _ in range(60):
        a = r.randrange(len(e.data))
        b, new = min(len(e.data), a + r.randint(0, 5)), bytes(r.choices(b"etao in", k=r.randint(0, 6)))
        far = max(far, e.edit(a, b, new))
        assert e.ids() == reference._encode_single_piece(e.data)
    assert far < len(data)


def test_cases(spark):
    docs = spark.createDataFrame([(1, None, 1, 2, 3), (2, "", 1, 2, 3), (3, "é 😀", 1, 2, 3), (3, "é 😀", 1, 2, 3), (None, "long " * 60_000, 1, 2, 3)], SCHEMA)
    both = byte_bpe.decode(byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN, to="coded"), RANKS, public_tokenizers.PATTERN, "coded", "back")
    assert both.columns == [*docs.columns, "coded", "back"]
    rows = both.collect()
    assert len(rows) == 5 and all(bytes(r.back).decode() == (r.text or "") and (r.ids, r.decoded, r["a.b"]) == (1, 2, 3) for r in rows)
    assert byte_bpe.digests(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_one_worker_encodes_and_decodes(spark):
    docs = spark.createDataFrame([("a b",), ("ünï 中 12",), (None,), ("",)], "text string")
    both = byte_bpe.encode_and_decode(docs, RANKS, public_tokenizers.PATTERN)
    apart = byte_bpe.decode(byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)
    assert both.columns == apart.columns and sorted(map(str, both.collect())) == sorted(map(str, apart.collect()))
    for df in (both, byte_bpe.digests(docs.withColumn("doc_id", F.lit(1)), RANKS, public_tokenizers.PATTERN)):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_a_token_that_no_merges_make():
    ranks = {bytes([i]): i for i in range(256)} | {b"abc": 256}
    library = tiktoken.Encoding("odd", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    codec = byte_bpe.Codec(b"\n".join(base64.b64encode(k) + b" " + str(v).encode() for k, v in ranks.items()), r"\S+|\s+")
    texts = ["abc", "xabc abc", "abcabc"]
    assert [list(struct.unpack(f"<{len(x) // 4}I", x)) for x in codec.encode(texts)] == [library.encode_ordinary(t) for t in texts]
    assert byte_bpe.PrefixEncoder(byte_bpe.Vocabulary(ranks), b"abc").ids() == [256]
