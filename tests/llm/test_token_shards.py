import numpy as np
import public_tokenizers
import pytest
import tiktoken
from lodeworks.llm import byte_bpe, registry, token_shards
from lodeworks.sources.tables import table

SCHEMA = "doc_id long, text string, slot int, task int, `a.b` int"


@pytest.mark.parametrize("size", [1, 2, 3, 5, 64, 1000, 4097])
def test_permutation(size):
    order = token_shards.Permutation(size, b"k")
    slots = order.slot(np.arange(size))
    assert sorted(slots.tolist()) == list(range(size)) and (order.number(slots) == np.arange(size)).all()
    if size >= 1000:
        assert (slots != token_shards.Permutation(size, b"other").slot(np.arange(size))).mean() > 0.9
        assert abs(np.corrcoef(slots, np.arange(size))[0, 1]) < 0.1


@pytest.fixture
def words():
    return lambda: lambda text: [len(w) for w in text.split()]


def test_records_stand_where_the_index_says(spark, tmp_path, words):
    docs = [(i, " ".join("x" * (1 + (i + k) % 9) for k in range(i * 3 % 41)), 1, 2, 3) for i in range(50)] + [(50, None, 1, 2, 3), (51, "", 1, 2, 3), (51, "", 1, 2, 3), (None, "x " * 9000, 1, 2, 3)]
    path = f"file://{tmp_path}/shards"
    index = token_shards.materialise(spark.createDataFrame(docs, SCHEMA).repartition(5), path, words, end=0, length=8, per_shard=16).collect()
    slots = {r.slot: r for r in index}
    assert sorted(slots) == list(range(len(index)))
    assert all((r.shard, r["at"]) == (r.slot // 16, r.slot % 16 * token_shards.stride(8)) for r in index)
    read = list(token_shards.read_slots(spark, path, 0, len(index) + 5, length=8, per_shard=16))
    assert len(read) == len(index)
    whole = {}
    for s, r in slots.items():
        whole.setdefault(r.doc_id, {}).setdefault(r.piece, []).append(read[s][: r.n_tokens].tolist())
        assert not read[s][r.n_tokens :].any()
    for i, text, *_ in docs[:50]:
        ids = [t for _, part in sorted(whole[i].items()) for t in part[0]]
        assert ids == [*words()(text), 0]
    assert whole[51] == {0: [[0], [0]]} and sum(len(v[0]) for v in whole[None].values()) == 9001
    again = list(token_shards.read_slots(spark, path, 37, 20, length=8, per_shard=16))
    assert [a.tolist() for a in again] == [a.tolist() for a in read[37:57]]


def test_no_rows(spark, tmp_path, words):
    df = spark.createDataFrame([], SCHEMA)
    path = f"file://{tmp_path}/none"
    assert token_shards.materialise(df, path, words, end=0).count() == 0 and not list(token_shards.read_slots(spark, path, 0, 5))


def test_query_holds_every_token(spark, sf_dir):
    reference = tiktoken.Encoding("r", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(byte_bpe.load_ranks(registry.BPE_RANKS)), special_tokens={})
    index = registry.op1_token_shards(spark, sf_dir).collect()
    read = dict(enumerate(token_shards.read_slots(spark, index[0].path, 0, len(index))))
    got = {}
    for r in sorted(index, key=lambda r: (r.doc_id, r.piece)):
        got.setdefault(r.doc_id, []).extend(read[r.slot][: r.n_tokens].tolist())
    assert got == {r.doc_id: [*reference.encode_ordinary(r.text or ""), 50256] for r in table(spark, sf_dir, "documents").collect()}
