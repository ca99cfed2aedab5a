import random

import pytest
from lodeworks.llm import line_dedup, registry
from lodeworks.sources.tables import table
from pyspark.sql import functions as F

from . import brute

SCHEMA = "doc_id long, text string, h1 string, n int, lines_kept string, `a.b` int"


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "clash", 1, "c", 2) for i, t in docs], SCHEMA).repartition(3)


def result(df):
    return {r.doc_id: (r.text, r.lines_removed) for r in df.collect()}


def edited(r, line):
    k, c = r.randrange(len(line)), r.choice("abcé")
    return r.choice([line[:k] + c + line[k:], line[:k] + line[k + 1 :], line[:k] + c + line[k + 1 :]])


@pytest.mark.parametrize("crowd", [2, 16])
def test_as_brute_force(spark, crowd):
    r = random.Random(crowd)
    base = ["".join(r.choices("abcd ", k=n)).strip() + "x" for n in (5, 18, 20, 21, 22, 40, 41, 300)]
    lines = list(base)
    for _ in range(260):  # neighbours and neighbours of neighbours, so that segments are crowded
        lines.append(edited(r, r.choice(lines)))
    docs = [(i, "\n".join(r.choice(["", " ", "\t"]) * r.randint(0, 1) + x for x in r.sample(lines, 9)) + r.choice(["", "\n", "\n\n"])) for i in range(40)]
    assert result(line_dedup.clean(frame(spark, docs), crowd=crowd)) == brute.cleaned_lines(docs)


def test_one_place_differs_in_many_lines(spark):
    # lines of one length that differ in one place, and those with a character more or less there: only crowded groups
    stem = "the same words again and again"
    docs = [(i, stem[:13] + chr(0x4E00 + i) * (i % 3) + stem[13:]) for i in range(90)]
    assert result(line_dedup.clean(frame(spark, docs), crowd=3)) == brute.cleaned_lines(docs)


def test_query_as_brute_force(spark, sf_dir):
    docs = sorted((r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect())
    assert result(registry.op3_line_dedup(spark, sf_dir)) == brute.cleaned_lines(docs)


def test_cases(spark):
    docs = frame(spark, [(1, None), (2, ""), (3, "\n\n"), (4, "a line\r\na line\t\nb"), (5, "b\nlonger " + "y" * 30_000), (6, "longer " + "y" * 30_001), (6, "longer " + "y" * 30_001)])
    got = line_dedup.clean(docs)
    assert set(docs.columns) | {"lines_removed"} == set(got.columns)
    rows = {r.doc_id: (r.text, r.lines_removed, r.lines_kept, r.h1, r.n, r["a.b"]) for r in got.collect()}
    more = ("clash", 1, 2)
    assert rows[1] == (None, 0, 0, *more) and rows[2] == ("", 0, 0, *more) and rows[3] == ("\n\n", 0, 0, *more)
    assert rows[4] == ("a line\r\nb", 1, 2, *more) and rows[5][1:] == (1, 1, *more) and rows[6] == ("", 1, 0, *more)
    assert got.count() == 7
    assert line_dedup.clean(frame(spark, [])).count() == 0


@pytest.mark.parametrize("crowd", [2, 16])
def test_short_lines_are_joined(spark, crowd):
    docs = frame(spark, [(1, "In.\nAs\nx"), (2, "It.\nAs.\n12"), (3, "y\nOf onthshes.\n1"), (4, "Of onthshe."), (5, "In and."), (6, "nineteen character"), (7, "nineteen characters!"), (8, "nineteen characters")])
    got = {r.doc_id: (r.text, r.lines_removed) for r in line_dedup.clean(docs, crowd=crowd).collect()}
    assert got == {1: ("In.\nAs\nx", 0), 2: ("12", 2), 3: ("Of onthshes.", 2), 4: ("", 1), 5: ("In and.", 0), 6: ("nineteen character", 0), 7: ("nineteen characters!", 0), 8: ("", 1)}
    assert got == brute.cleaned_lines(sorted((r.doc_id, r.text) for r in docs.collect()))
    many = [(i, "\n".join(f"{a}{b}" for a in "abcdefgh" for b in range(i, 10))) for i in range(8)]
    assert result(line_dedup.clean(frame(spark, many), crowd=crowd)) == brute.cleaned_lines(many)


def test_null_ids_come_last(spark):
    rows = line_dedup.clean(frame(spark, [(None, "this is a line of some length"), (7, "this is a line of some lengths")])).collect()
    assert sorted((str(r.doc_id), r.lines_removed) for r in rows) == [("7", 0), ("None", 1)]


@pytest.mark.parametrize("k", [1, 3])
def test_banded_distance(spark, k):
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    r = random.Random(k)
    pairs = []
    for _ in range(300):
        b = "".join(r.choices("ab", k=r.randint(0, 12)))
        a = b
        for _ in range(r.randint(0, 4)):
            a = edited(r, a) if a else "a"
        a, b = sorted((a, b), key=len, reverse=True)
        if len(a) - len(b) <= k:
            pairs.append((a, b))
    df = spark.createDataFrame(pairs, "a string, b string")
    for x in df.select("a", "b", line_dedup.banded_distance(F.col("a"), F.col("b"), k).alias("d")).collect():
        want = plain(x.a, x.b)
        assert (x.d == want) if want <= k else x.d > k, tuple(x)
