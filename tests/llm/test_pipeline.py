"""The pipeline against a plain version of each stage, and every stage on odd input."""

import struct

import public_tokenizers
import pytest
import tiktoken
from lodeworks.llm import byte_bpe, language_id, registry
from lodeworks.sources.tables import table

from . import brute

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_as_brute_force(spark, sf_dir):
    source = table(spark, sf_dir, "documents")
    model = language_id.train(source, byte_bpe.load_ranks(registry.PIECE_RANKS))
    docs = sorted((r.doc_id, r.text) for r in source.collect())
    said = language_id.Scorer(model).score([t for _, t in docs])
    docs = [d for d, (lang, score) in zip(docs, said, strict=True) if lang != "und" and score >= 0.5]
    texts = brute.cleaned_lines(docs)
    docs = [(i, t) for i, (t, gone) in texts.items() if not gone or t.strip()]
    part = brute.near_copies(docs)
    docs = [(i, t) for i, t in docs if part[i] == i]
    hit = {d for d, _ in brute.leaks(docs, [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()])}
    reference = tiktoken.Encoding("r", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(byte_bpe.load_ranks(registry.BPE_RANKS)), special_tokens={})
    want = {i: reference.encode_ordinary(t) for i, t in docs if i not in hit}
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id: list(struct.unpack(f"<{r.n_tokens}I", r.ids)) for r in rows} == want and all(r.round_trip for r in rows)


TEXT = "ordinary words in a plain sentence that says nothing much of note"
LONG = "w " * 30_000
ROWS = [(1, None, None, None, None), (2, "", "en", "web", 0), (3, LONG, "en", "web", 60_000), (4, TEXT, "en", "web", 65), (4, TEXT, "en", "web", 65), (None, TEXT, None, None, 65)]
#: What each stage keeps of ROWS: rows and their ids.
KEPT = {
    "language_id": [None, 3, 4, 4],
    "line_dedup": [1, 2, 3, 4, 4],
    "simhash": [1, 3, 4],
    "decontaminate": [None, 1, 2, 3, 4, 4],
    "byte_bpe": [None, 1, 2, 3, 4, 4],
}
CLASHES = ["k1", "_k2", "row", "removed", "kept", "lines", "a.b", "c0"]


@pytest.mark.parametrize("name, work", corpus_pipeline.STAGES)
def test_stage_on_odd_rows(spark, sf_dir, name, work):
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table(spark, sf_dir, "documents").schema) + "".join(f", `{c}` int" for c in CLASHES)
    more = tuple(range(len(CLASHES)))
    for some in (ROWS, []):
        got = work(spark, spark.createDataFrame([(*r, *more) for r in some], columns), sf_dir)
        rows = got.collect()
        assert sorted(map(str, (r.doc_id for r in rows))) == sorted(map(str, KEPT[name])) if some else not rows
        if name != corpus_pipeline.STAGES[-1][0]:
            assert got.columns == [*table(spark, sf_dir, "documents").columns, *CLASHES]
            assert all(tuple(r)[-len(CLASHES) :] == more for r in rows)
