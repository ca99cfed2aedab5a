import zlib

import numpy as np
import pytest
import regex
from lodeworks.llm import byte_bpe, language_id, registry
from lodeworks.sources.tables import table

SCHEMA = "doc_id long, text string, lang string, score string, lang_pred int, `a.b` int, row int, _lang int"
RANKS = byte_bpe.load_ranks(registry.PIECE_RANKS)


@pytest.fixture(scope="module")
def model(spark):
    return language_id.train(table(spark, "/root/testdata/sf0.01", "documents"), RANKS)


def frame(spark, docs):
    return spark.createDataFrame([(i, t, g, "clash", 1, 2, 3, 4) for i, t, g in docs], SCHEMA).repartition(3)


def plain_log_prob(model, word):
    """The sum over all segmentations, in logarithms, a byte at a time."""
    place = {p: k for k, p in enumerate(model.pieces)}
    total = [np.zeros(len(model.languages))]
    for end in range(1, len(word) + 1):
        ways = [total[s] + np.log(model.prob[place[word[s:end]]]) for s in range(end) if word[s:end] in place]
        total.append(np.logaddexp.reduce(ways, axis=0))
    return total[-1]


def test_the_sum_over_all_segmentations(model):
    # short and long words, pieces of over eight bytes, words longer than any block
    words = [" the", " de", " maison", " größe", " x", " international", " internationalization" * 4, " " + "donaudampfschiff" * 9, " " + "w" * 700]
    assert max(map(len, model.pieces)) > 8
    data = [w.encode() for w in words]
    for w, row in zip(data, model.log_prob(data), strict=True):
        assert np.allclose(row, plain_log_prob(model, w)), w


def test_long_and_short_words_are_learned_alike(model):
    words = [" international".encode() * 2, " größe".encode()]
    p = model.prob[:, :1]
    batched = model.expect(words, np.array([2.0, 3.0]), p)
    short, language_id.SHORT = language_id.SHORT, 0
    try:
        single = model.expect(words, np.array([2.0, 3.0]), p)
    finally:
        language_id.SHORT = short
    assert np.allclose(batched, single) and batched.sum() > 0


def test_query_as_plain_python(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model, known = language_id.train(docs, RANKS), {}
    got = {r.doc_id: (r.lang_pred, r.score) for r in registry.op5_language_id(spark, sf_dir).collect()}
    for r in docs.collect():
        words = regex.findall(r"\p{L}[\p{L}\p{M}]*", (r.text or "").lower())
        total = np.zeros(len(model.languages))
        for w in words:
            if w not in known:
                known[w] = plain_log_prob(model, b" " + w.encode())
            total += known[w]
        want = (model.languages[int(total.argmax())], 1 / np.exp(total - total.max()).sum()) if words else ("und", 0.0)
        assert got[r.doc_id][0] == want[0] and abs(got[r.doc_id][1] - want[1]) < 1e-6


def test_probabilities(model):
    assert np.allclose(model.prob.sum(axis=0), 1) and (model.prob[:-1] > 0).all() and not model.prob[-1].any()


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    lang = {r.doc_id: (r.lang, r.text) for r in table(spark, d, "documents").collect()}
    rows = registry.op5_language_id(spark, d).collect()
    assert {r.doc_id for r in rows} == set(lang) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    judged = [(r.lang_pred, lang[r.doc_id][0]) for r in rows if r.held_out and r.lang_pred != "und" and lang[r.doc_id][0]]
    assert len(judged) > 150 and sum(a == b for a, b in judged) / len(judged) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_cases(spark, model):
    docs = frame(spark, [(1, None, "en"), (2, "", None), (3, "12 ! 😀", "en"), (4, "x", None), (4, "x", None), (None, "der und das " * 20_000, None), (6, "w" * 50_000, None)])
    got = language_id.predict(docs, model, to=("p", "s"))
    assert got.columns == [*docs.columns, "p", "s"]
    rows = got.collect()
    assert len(rows) == 7 and all((r.score, r.lang_pred, r["a.b"]) == ("clash", 1, 2) for r in rows)
    assert {r.doc_id for r in rows if r.p == "und"} == {1, 2, 3} and all(r.s == 0 for r in rows if r.p == "und")
    kept = language_id.accepted(docs, model)
    assert kept.columns == docs.columns and all(r.score == "clash" for r in kept.collect())
    assert language_id.predict(docs.limit(0), model).count() == 0


def test_nothing_to_learn_from(spark):
    docs = frame(spark, [(1, "some words", None), (None, "more words", "en")])
    model = language_id.train(docs, RANKS)
    assert model is None and {r.lang_pred for r in language_id.predict(docs, model).collect()} == {"und"}


def test_held_out_rows_are_not_learned_from(spark):
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 4 == 2]
    docs = frame(spark, [(i, "some words", "zz" if i in ids else "en") for i in range(60)])
    assert language_id.train(docs, RANKS).languages == ["en"]
