"""What must not grow: rows through the driver, rows of a step that are no result."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lodeworks.operators import clones, closure, complexity
from lodeworks.plans import catalogue
from lodeworks.rules import shapes
from lodeworks.sources.facts import Facts


def plans(spark, ran):
    """The plans of what ``ran`` executes."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    ran()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    found = store.executionsList()
    return [found.apply(i).physicalPlanDescription() for i in range(before, found.size())]


@pytest.mark.parametrize("name", ["transitive_closure", "consumers_closure", "exclusive_subtree", "strongest_requirement", "flow_surviving"])
def test_closures_broadcast_nothing(spark, sf_dir, name):
    made = plans(spark, lambda: catalogue.QUERIES[name](spark, sf_dir).collect())
    assert made and not [p for p in made if "BroadcastExchange" in p]


def test_closure_of_a_graph_with_cycles_and_nulls(spark):
    edges = [(1, 2, True), (2, 3, True), (3, 1, True), (3, 4, False), (4, 5, True), (1, 4, False), (2, 4, True), (5, 5, True), (6, None, True), (None, 7, True), (2, 6, True), (1, 6, True)]
    df = spark.createDataFrame(edges, "src long, dst long, go boolean")
    for onward in (None, "go"):
        expected = {}
        for root in {s for s, _, _ in edges if s is not None}:
            best, front, depth, gone = {}, {root}, 0, set()
            while front:
                depth += 1
                reached = defaultdict(bool)
                for s, d, go in edges:
                    if s in front and s is not None:
                        reached[d] |= go or onward is None
                for d in reached:
                    best.setdefault(d, depth)
                front = {d for d, go in reached.items() if go and d is not None and d not in gone}
                gone |= front
            expected |= {(root, d): n for d, n in best.items()}
        got = [tuple(r) for r in closure.closure(df, onward=onward).select("root", "node", "depth").collect()]
        assert len(got) == len(expected) and {(r, n): d for r, n, d in got} == expected
    some = closure.closure(df, roots=spark.createDataFrame([(6,), (2,), (2,)], "root long")).select("root").distinct().collect()
    assert sorted(r.root for r in some) == [2, 6]


@pytest.mark.parametrize("name", ["cognitive", "rule_cognitive"])
def test_nesting_broadcasts_nothing_and_reads_its_input_a_few_times(spark, sf_dir, name):
    made = plans(spark, lambda: catalogue.QUERIES[name](spark, sf_dir).collect())
    assert not [p for p in made if "BroadcastExchange" in p]
    assert sum("lineitem.parquet" in p for p in made) == 1


def test_nesting_of_deep_bodies_orphans_and_circles(spark):
    chain = [("deep", i, i - 1 if i else None, "if" if i % 3 else "block") for i in range(150)]
    odd = [("odd", 1, None, "if"), ("odd", 2, 1, "else"), ("odd", 3, 99, "if"), ("odd", 4, 3, "if"), ("odd", 5, 6, "if"), ("odd", 6, 5, "if"), ("odd", 7, 2, "block"), (None, 1, None, "if"), (None, 2, 1, "if")]
    df = spark.createDataFrame(chain + odd, "body_id string, node_id long, parent_id long, kind string")
    got = {(r.body_id, r.node_id): r.nesting for r in complexity.nested(df).collect()}
    deep = {("deep", i): sum(bool(j % 3) for j in range(i)) for i in range(150)}
    assert got == deep | {("odd", 1): 0, ("odd", 2): 1, ("odd", 7): 2, (None, 1): 0}


def test_sets_that_begin_on_one_line_are_one_finding_each(spark):
    # two fragments of a line of f/a each occur in one other file
    lines = lambda tag, n: [f"{tag}{i}" for i in range(n)]
    texts = {"f/a": ["own"] + lines("s", 70), "g/b": lines("s", 70), "g/c": ["own"] + lines("s", 62)}
    rows = [(p, i, t, 1 + i // 8) for p, ts in texts.items() for i, t in enumerate(ts)]
    f = Facts(spark, tables={"tokens": spark.createDataFrame(rows, "path string, idx int, tok string, line int")})
    sets = shapes.clone_sets(f).select("set_id").distinct().count()
    got = shapes.duplicated(f).collect()
    assert sets == len(got) == 2 and [(r.file_path, r.line_number, len(r.related)) for r in got] == [("f/a", 1, 1)] * 2


def brute(texts, width, cap):
    places = defaultdict(list)
    for p in sorted(texts):
        for i in range(len(texts[p]) - width + 1):
            places[tuple(texts[p][i : i + width])].append((p, i))
    pairs = {(a, b, i, j) for at in places.values() for a, i in at[:cap] for b, j in at[:cap] if a < b}
    out = []
    for a, b, i, j in pairs:
        if (a, b, i - 1, j - 1) not in pairs:
            n = 0
            while (a, b, i + n, j + n) in pairs:
                n += 1
            out.append((a, b, i, j, n + width - 1))
    return sorted(out)


@pytest.mark.parametrize("cap", [3, 512, None])
def test_islands_equal_all_pairs_of_windows(spark, cap):
    rnd = random.Random(7)
    texts = {f"f{i:02}": [rnd.choice("ab") for _ in range(rnd.randrange(0, 40))] for i in range(12)}
    df = spark.createDataFrame(list(texts.items()), "path string, t array<string>")
    got = clones.islands(clones.windows(df, "path", F.col("t"), 4), 4, cap)
    assert sorted(tuple(r) for r in got.select("l_path", "r_path", "l_start", "r_start", "len").collect()) == brute(texts, 4, cap)


def test_rows_of_a_run_dont_grow_with_its_length(spark):
    df = spark.createDataFrame([(f"f{i:02}", [f"t{k}" for k in range(500)]) for i in range(30)], "path string, t array<string>")
    made = clones.islands(clones.windows(df, "path", F.col("t"), 4), 4)
    assert made.count() == 435
    rows = []

    def walk(node):
        metrics = node.metrics()
        if metrics.contains("shuffleRecordsWritten"):
            rows.append(metrics.apply("shuffleRecordsWritten").value())
        for x in (node.executedPlan(),) if node.nodeName().startswith("Adaptive") else (node.plan(),) if "QueryStage" in node.nodeName() else [node.children().apply(i) for i in range(node.children().size())]:
            walk(x)

    made.collect()
    walk(made._jdf.queryExecution().executedPlan())
    assert rows and max(rows) <= 30 * 500


def test_unused_project_walks_each_graph_once(spark, sf_dir, monkeypatch):
    from lodeworks.rules import packages
    from lodeworks.sources import facts

    walks = []
    for module in (packages, facts):
        monkeypatch.setattr(module, "closure", lambda *a, f=module.closure, **k: walks.append(k) or f(*a, **k))
    catalogue.QUERIES["rule_unused_project"](spark, sf_dir)
    assert len(walks) == 2
