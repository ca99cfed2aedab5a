import random

import numpy as np
import pytest
from lodeworks.llm import registry, simhash
from lodeworks.sources.tables import table

from . import brute

SCHEMA = "doc_id long, text string, fp string, `part.a` int, k1 string, _k2 int"


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "clash", 1, "k", 2) for i, t in docs], SCHEMA).repartition(3)


def test_query_as_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in registry.op7_simhash(spark, sf_dir).collect()}
    assert got == brute.near(docs)


def test_odd_texts(spark):
    docs = [(5, None), (6, ""), (7, " \t\n"), (8, "one"), (9, "ONE"), (10, "a b c"), (11, "a b c d"), (12, "Ä ä x y z"), (13, "w " * 40_000), (14, "W " * 40_001)]
    got = {r.doc_id: (f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in simhash.components(frame(spark, docs)).collect()}
    assert got == brute.near(docs)
    assert got[5] == ("0" * 16, 5) == got[7][:1] + (5,)


def test_repeated_rows_null_ids_and_nothing(spark):
    rows = simhash.components(frame(spark, [(3, "a b c d e"), (3, "a b c d e"), (None, "a b c d e"), (None, "q r s t u v")])).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in rows) == [("3", "3"), ("3", "3"), ("None", "3"), ("None", "None")]
    assert simhash.components(frame(spark, [])).count() == 0


@pytest.mark.parametrize("crowd", [2, 40, 4096])
def test_links_connect_all_in_range(spark, crowd):
    r = random.Random(4)
    points = {r.getrandbits(64) for _ in range(150)}
    base = r.getrandbits(64)
    for _ in range(250):  # a dense ball, so that cells are crowded, and chains away from it
        x = base
        for b in r.sample(range(64), r.randint(1, 9)):
            x ^= 1 << b
        points.add(x)
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in points], "fp long")
    got = [(x.a & (1 << 64) - 1, x.b & (1 << 64) - 1) for x in simhash.near_links(df, 4, crowd).collect()]
    assert all((a ^ b).bit_count() <= 64 for a, b in got)
    want = [(a, b) for a in points for b in points if a < b and (a ^ b).bit_count() <= 4]
    assert brute.components(points, got) == brute.components(points, want)


def test_embedding_is_a_lower_bound():
    r = np.random.default_rng(1)
    a, b = (r.integers(0, 2**63, 2000, dtype=np.uint64) for _ in range(2))
    counts = lambda x: np.stack([np.bitwise_count(x >> np.uint64(2 * i) & np.uint64(3)) for i in range(32)]).astype(int)
    far = np.abs(counts(a) - counts(b)).sum(axis=0)
    assert (simhash.manhattan(simhash.points_of(a), simhash.points_of(b)) == far).all()
    assert (far <= np.bitwise_count(a ^ b)).all() and (far < np.bitwise_count(a ^ b)).any()


def test_points_in_range_share_a_cell(spark):
    r = random.Random(9)
    for _ in range(300):
        a = r.getrandbits(64)
        b = a
        for k in r.sample(range(64), 4):
            b ^= 1 << k
        p, q = (simhash.points_of(np.array([x], np.uint64)) for x in (a, b))
        assert ((p & simhash.GRIDS) == (q & simhash.GRIDS)).any()


@pytest.mark.parametrize("radius", [0, 2, 4])
def test_midpoints_alone_connect_all_in_range(spark, radius):
    r = random.Random(radius)
    base = r.getrandbits(64)
    points = {base}
    while len(points) < 60:
        x = base
        for k in r.sample(range(64), r.randint(0, 6)):
            x ^= 1 << k
        points.add(x)
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in points], "fp long")
    got = [(x.a & (1 << 64) - 1, x.b & (1 << 64) - 1) for x in simhash.midpoint_links(df, radius).collect()]
    assert all((a ^ b).bit_count() <= radius for a, b in got)
    want = [(a, b) for a in points for b in points if a < b and (a ^ b).bit_count() <= radius]
    assert brute.components(points, got) == brute.components(points, want)


def test_keep_one(spark):
    text = "the quick brown fox jumps over the lazy dog and runs away from the bear " * 8
    docs = frame(spark, [(4, text), (2, text), (2, text), (9, "something else entirely is told here"), (None, text)])
    got = simhash.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted(tuple(x) for x in got.collect()) == [(2, text, "clash", 1, "k", 2), (9, "something else entirely is told here", "clash", 1, "k", 2)]
