import random

import corpus_pipeline
import pytest
from lodeworks.llm import near_copies

from . import brute

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, k1 int, _k2 int, row int"


def corpus(n):
    r = random.Random(11)
    word = lambda: "".join(r.choices("abcdefgh", k=6))
    docs = []
    for _ in range(n):
        words = [word() for _ in range(r.randint(60, 300))]
        docs.append(" ".join(words))
        for _ in range(r.randint(1, 2)):
            copy = list(words)
            for k in r.sample(range(len(words)), r.randint(1, max(1, len(words) // 40))):
                copy[k] = word()
            docs.append(" ".join(copy))
    return list(enumerate(docs))


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "en", "web", len(t or ""), 1, 2, 3) for i, t in docs], COLUMNS).repartition(3)


@pytest.mark.parametrize("crowd", [1, 16])
def test_components_as_brute_force(spark, crowd):
    docs = corpus(60)
    want = brute.near_copies(docs)
    rows = near_copies.components(frame(spark, docs), crowd=crowd).collect()
    least = {}
    for r in rows:
        least[r.part] = min(r.doc_id, least.get(r.part, r.doc_id))
    assert {r.doc_id: least[r.part] for r in rows} == want and len(set(want.values())) < len(docs)


def test_the_pipeline_stage_drops_copies_beyond_four_bits(spark, sf_dir):
    docs = corpus(30)
    part = brute.near_copies(docs)
    got = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, frame(spark, docs), sf_dir).collect()}
    assert got == {i for i in part if part[i] == i}


@pytest.mark.parametrize("rows", [0, 500_000])
def test_kept_documents_by_either_join(spark, sf_dir, monkeypatch, rows):
    monkeypatch.setattr(near_copies, "BROADCAST_ROWS", rows)
    docs = corpus(20)
    part = brute.near_copies(docs)
    got = near_copies.keep_one(frame(spark, docs))
    assert {r.doc_id for r in got.collect()} == {i for i in part if part[i] == i} and got.count() == len(set(part.values()))


def test_the_stage_takes_fingerprints_and_the_grid(spark, sf_dir, monkeypatch):
    asked, links = [], near_copies.near_links
    monkeypatch.setattr(near_copies, "near_links", lambda points: asked.append({r.fp % 2**64 for r in points.collect()}) or links(points))
    docs = [*corpus(20), (900, None), (901, "one two")]
    fp = {i: brute.simhash(t, near_copies.WIDTH) for i, t in docs}
    corpus_pipeline.drop_near_copies(spark, frame(spark, docs), sf_dir).count()
    assert asked == [{fp[i] for i, t in docs if t}]
    part = brute.components(fp, [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 4])
    rows = spark.createDataFrame([(i, v - (v >> 63 << 64)) for i, v in fp.items()], "node long, fp long")
    cell = {r.node: r.cell for r in near_copies.grid_cells(rows).collect()}
    assert len(set(part.values())) < len(docs) and all((part[a] == part[b]) == (cell[a] == cell[b]) for a in fp for b in fp)


def test_blank_short_and_repeated(spark):
    docs = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "ONE two"), (5, "ONE two"), (None, "one two"), (6, "one three")]
    got = near_copies.keep_one(frame(spark, docs))
    assert sorted(r.doc_id for r in got.collect()) == [1, 4, 6]
    assert near_copies.keep_one(frame(spark, [])).count() == 0


def chained(r, steps):
    """Texts of which each is near the next one only: a cell of theirs has many components at first."""
    words = ["".join(r.choices("abcdefgh", k=6)) for _ in range(120)]
    out = []
    for _ in range(steps):
        out.append(" ".join(words))
        words = words[2:] + ["".join(r.choices("abcdefgh", k=6)) for _ in range(2)]
    return out


@pytest.mark.parametrize("leaders, block", [(1, 2), (2, 64), (16, 8)])
def test_crowded_cells_lose_no_link(spark, monkeypatch, leaders, block):
    for name, value in (("LEADERS", leaders), ("BLOCK", block), ("SLICE", 5)):
        monkeypatch.setattr(near_copies, name, value)
    r = random.Random(3)
    plain = " ".join("".join(r.choices("abcdefgh", k=6)) for _ in range(200)).split()
    texts = chained(r, 25)
    for _ in range(25):  # one text with words changed here and there: similar to it, less so to each other; then half of it only
        copy = list(plain)
        for k in r.sample(range(200), r.randint(1, 7)):
            copy[k] = "".join(r.choices("xyz", k=6))
        texts.append(" ".join(copy))
        texts.append(" ".join(plain[:120] + ["".join(r.choices("xyz", k=6)) for _ in range(80)]))
    docs = list(enumerate(texts))
    want = brute.near_copies(docs)
    rows = near_copies.components(frame(spark, docs), crowd=2).collect()
    least = {}
    for x in rows:
        least[x.part] = min(x.doc_id, least.get(x.part, x.doc_id))
    assert {x.doc_id: least[x.part] for x in rows} == want
