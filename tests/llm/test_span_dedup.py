import random

from lodeworks.llm import registry, span_dedup
from lodeworks.sources.tables import table

from . import brute

SCHEMA = "doc_id long, text string, i int, k int, start int, `a.b` int, _both int, row int"


def frame(spark, docs):
    return spark.createDataFrame([(i, t, 1, 2, 3, 4, 5, 6) for i, t in docs], SCHEMA).repartition(3)


def result(df):
    return {r.doc_id: (r.text, r.sentences_removed) for r in df.collect()}


def test_as_brute_force(spark):
    r = random.Random(5)
    said = [" ".join(r.choices("ab cd ef gh Ij kl mn".split(), k=r.randint(1, 14))) + r.choice(".!?") for _ in range(30)]
    said += [" ".join(r.choices([f"w{k}" for k in range(40)], k=r.randint(26, 60))) + "." for _ in range(6)]
    docs = [(i, r.choice([" ", "\n", "\n\n  "]).join(r.choices(said, k=r.randint(1, 14)))) for i in range(70)]
    docs = [(i, "  " + t if i % 7 == 0 else t) for i, t in docs]
    assert result(span_dedup.remove(frame(spark, docs))) == brute.without_spans(docs)


def test_query_as_brute_force(spark, sf_dir):
    docs = sorted((r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect())
    assert result(registry.op2_span_dedup(spark, sf_dir)) == brute.without_spans(docs)


def words(r, n):
    return " ".join("".join(r.choices("abcdefgh", k=7)) for _ in range(n))


def test_a_passage_goes_from_all_but_the_first(spark):
    r = random.Random(6)
    passage = words(r, 20) + ". " + words(r, 21) + "."
    docs = [(i, f"{words(r, 20)}. {passage} {words(r, 20)}.") for i in range(6)] + [(9, words(r, 80))]
    got = result(span_dedup.remove(frame(spark, docs)))
    assert got[0] == (docs[0][1], 0) and got[9] == (docs[6][1], 0)
    for i in range(1, 6):
        assert got[i][1] == 2 and passage not in got[i][0] and got[i][0] == docs[i][1].replace(passage + " ", "")


def test_a_passage_inside_long_sentences(spark):
    r = random.Random(8)
    passages = [words(r, 60) for _ in range(60)]
    docs = []
    for i, p in enumerate(passages):  # no mark and no capital anywhere near: only the words themselves tell where to cut
        docs += [(2 * i, f"{words(r, 40)} {p} {words(r, 40)}"), (2 * i + 1, f"{words(r, 33)} {p} {words(r, 47)}")]
    got = result(span_dedup.remove(frame(spark, docs)))
    assert all(got[2 * i] == (docs[2 * i][1], 0) for i in range(60))
    found = [i for i in range(60) if got[2 * i + 1][1]]
    assert len(found) >= 57
    for i in found:  # nothing but words of the passage goes
        left, ahead, behind = got[2 * i + 1][0].split(), docs[2 * i + 1][1].split()[:33], docs[2 * i + 1][1].split()[-47:]
        assert left[:33] == ahead and left[-47:] == behind and len(left) <= 140 - 36


def test_cases(spark):
    long = "Wort für Wort und weiter " * 9000
    docs = frame(spark, [(1, None), (2, ""), (3, "few words"), (4, "few words"), (5, long), (6, long), (None, long), (6, long)])
    got = span_dedup.remove(docs)
    assert got.columns[: len(docs.columns)] == docs.columns or set(docs.columns) <= set(got.columns)
    rows = got.collect()
    assert len(rows) == 8 and all((r.i, r.k, r.start, r["a.b"], r._both, r.row) == (1, 2, 3, 4, 5, 6) for r in rows)
    by = {r.doc_id: r for r in rows}
    assert by[1].text is None and by[2].text == "" and by[4].text == "few words" and by[6].text == "" == by[None].text
    assert span_dedup.remove(frame(spark, [])).count() == 0


def test_scripts_without_spaces(spark):
    r = random.Random(7)
    said = lambda n: "".join(chr(r.randint(0x4E00, 0x9000)) for _ in range(n)) + "。"
    passage = said(22) + said(18)
    docs = [(i, said(22) + passage + said(22)) for i in range(3)]
    got = result(span_dedup.remove(frame(spark, docs)))
    assert got == {0: (docs[0][1], 0)} | {i: (docs[i][1].replace(passage, ""), 2) for i in (1, 2)}
