import random

from lodeworks.llm import exact_dedup
from pyspark.sql import functions as F

from . import brute

SCHEMA = "doc_id long, text string, keep_id string, row int"


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in docs], SCHEMA).repartition(3)


def test_as_brute_force(spark):
    r = random.Random(1)
    texts = [None, "", "É Abc", "é abc", "É aBC", "x" * 60_000, "X" * 60_000, "a. b\n" * 900] + ["".join(r.choices("aAb .\n", k=r.randint(1, 900))) for _ in range(20)]
    docs = [(i, r.choice(texts)) for i in range(120)]
    got = {x.doc_id: (x.keep_id, x.group_size, x.kept, x.text_sha256) for x in exact_dedup.exact_groups(frame(spark, docs)).collect()}
    assert got == brute.exact(docs)


def test_ties_nulls_and_nothing(spark):
    rows = [tuple(x)[:4] for x in exact_dedup.exact_groups(frame(spark, [(1, "a"), (1, "A"), (None, "a"), (None, None), (None, "")])).collect()]
    assert sorted(rows[k][3] for k in range(5)) == [False, False, False, True, True]
    assert {x[1] for x in rows} == {1, None} and sum(x[3] for x in rows if x[1] == 1) == 1
    assert exact_dedup.exact_groups(frame(spark, [])).count() == 0


def test_chunks_join_to_the_text(spark):
    r = random.Random(2)
    texts = ["".join(r.choices("ab .\né😀", k=n)) for n in (0, 1, 255, 256, 257, 5000, 30_000)] + ["z" * 10_000]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", exact_dedup.chunks(F.col("text")).alias("c"))
    for x in df.collect():
        assert "".join(x.c).encode("latin-1").decode() == x.text and all(len(c) <= exact_dedup.MOST for c in x.c)
        assert all(len(c) >= exact_dedup.LEAST for c in x.c[:-1])


def test_an_edit_changes_chunks_near_it(spark):
    r = random.Random(3)
    text = "".join(r.choices("abcdefgh ", k=40_000))  # no mark, no line break
    df = spark.createDataFrame([(text,), (text[:9000] + "Q" + text[9000:],)], "text string")
    a, b = (x.c for x in df.select(exact_dedup.chunks(F.col("text")).alias("c")).collect())
    assert len(a) > 20 and len(set(a) - set(b)) <= 3
    table = exact_dedup.chunk_table(df)
    assert table.where("copies = 2").count() >= len(a) - 4 and table.where("contents > 1").count() == 0


def test_identifiers_are_verified(spark):
    """With a hash of eight values chunks collide; the groups stay right as collisions are seen and other hashes taken."""
    salts = []

    def weak(chunk, salt):
        salts.append(salt)
        h = exact_dedup.hashed(chunk, salt)
        return h if salt > 1 else F.struct(F.pmod(h["h1"], F.lit(8)).alias("h1"), F.lit(0).cast("bigint").alias("h2"))

    r = random.Random(4)
    docs = [(i, "".join(r.choices("ab", k=r.choice([3, 700])))) for i in range(60)] + [(100 + i, "same text") for i in range(5)]
    got = {x.doc_id: (x.keep_id, x.group_size, x.kept, x.text_sha256) for x in exact_dedup.exact_groups(frame(spark, docs), hashes=weak).collect()}
    assert got == brute.exact(docs) and max(salts) == 2


def test_the_recipe_alone_makes_groups(spark, monkeypatch):
    """Without its chunks the operator takes all texts for one."""
    monkeypatch.setattr(exact_dedup, "chunks", lambda t, least=0, most=0: F.filter(F.array(t), lambda x: F.lit(False)))
    rows = exact_dedup.exact_groups(frame(spark, [(1, "a"), (2, "b")])).collect()
    assert {x.group_size for x in rows} == {2}


def test_deduplicate_keeps_columns(spark):
    df = frame(spark, [(1, "a"), (2, "A"), (3, "b")])
    assert sorted(tuple(x) for x in exact_dedup.deduplicate(df).collect()) == [(2, "A", "clash", 1), (3, "b", "clash", 1)]
