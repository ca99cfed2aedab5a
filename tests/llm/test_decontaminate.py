import random

import pytest
from lodeworks.llm import decontaminate, registry
from lodeworks.sources.tables import table
from pyspark.sql import functions as F

from . import brute

SCHEMA = "doc_id long, text string, tokens int, item_id int, `a.b` int"
ITEM = "A train leaves the old town of Berlin at 40 km an hour, and Anna counts 40 cars and 12 km of track before she sleeps"


def frame(spark, docs):
    return spark.createDataFrame([(i, t, 1, 2, 3) for i, t in docs], SCHEMA).repartition(3)


def bench(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def found(df):
    return {(r.doc_id, r.item_id): (pytest.approx(r.coverage), r.reparameterised) for r in df.collect()}


def test_templates(spark):
    texts = [ITEM, "", "5km, 5 km 5  km 5   km Five KM 1,000.5 Euros", "Ümlaut und Österreich; Es, Wie: So. Nicht Ja", "x9y 9Z 3 Lbs Of It", "a\nB c  D e    F"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", decontaminate.template(F.col("t")).alias("a"), decontaminate.raw_tokens(F.col("t")).alias("b"))
    for r in df.collect():
        assert [(x, y.lower()) for x, y in zip(r.a, r.b, strict=True)] == brute.template(r.t)


def test_reparameterised_and_contradicted(spark):
    changed = ITEM.replace("40", "75").replace("12", "9").replace("Berlin", "Oslo").replace("Anna", "Bob")
    torn = ITEM.replace("40 km", "75 km")  # one number stands for two
    docs = [(1, f"Before it. {ITEM}. After it."), (2, f"It says. {changed}."), (3, f"so it is said that {torn}."), (4, ITEM.upper()), (5, "A train leaves the old town and comes back"), (6, None), (7, "")]
    got = found(decontaminate.leaks(frame(spark, docs), bench(spark, [(10, ITEM)])))
    assert got == brute.leaks(docs, [(10, ITEM)])
    assert got[1, 10] == (1.0, False) and got[2, 10] == (1.0, True) and (5, 10) not in got
    assert (3, 10) not in got or got[3, 10][0].expected < 1  # what contradicts itself is not counted


def test_query_as_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    got = found(registry.op9_decontaminate(spark, sf_dir))
    assert got == brute.leaks(docs, items)
    held = {(d, i) for d, x in docs for i, q in items if x and q.lower() in x.lower()}
    assert held and held <= set(got)


def test_short_equal_and_empty_items(spark):
    items = [(1, "one two three four five six"), (2, "one two three four five six"), (3, "too short"), (4, None), (5, ""), (None, "seven eight nine ten eleven")]
    docs = [(1, "zero one two three four five six seven"), (1, "zero one two three four five six seven"), (None, "seven eight nine ten eleven")]
    got = decontaminate.leaks(frame(spark, docs), bench(spark, items))
    assert sorted((str(r.doc_id), str(r.item_id)) for r in got.collect()) == [("1", "1"), ("1", "2"), ("None", "None")]
    assert decontaminate.leaks(frame(spark, docs), bench(spark, [])).count() == 0
    assert decontaminate.leaks(frame(spark, []), bench(spark, items)).count() == 0


def test_clean_keeps_columns_and_repeats(spark):
    docs = frame(spark, [(1, ITEM), (2, "clean"), (2, "clean"), (None, None), (3, "word " * 50_000)])
    got = decontaminate.clean(docs, bench(spark, [(1, ITEM)]))
    assert got.columns == docs.columns
    assert sorted(str(r.doc_id) for r in got.collect()) == ["2", "2", "3", "None"]


def test_shuffled_join_gives_the_same(spark, sf_dir, monkeypatch):
    want = sorted(map(str, registry.op9_decontaminate(spark, sf_dir).collect()))
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    assert sorted(map(str, registry.op9_decontaminate(spark, sf_dir).collect())) == want


def test_equal_numbers_vary_and_a_torn_copy_counts(spark):
    apples = "so there are 2 apples in the red bowl and 2 pears in the blue bowl of the kitchen"
    r = random.Random(1)
    words = " ".join("".join(r.choices("abcdefgh", k=6)) for _ in range(60))
    copy = f"long ago old Anna begins it {words} before old Anna ends it"
    torn = copy.replace("old Anna ends", "old Bertha ends")
    docs = [(1, apples.replace("2 apples", "3 apples").replace("2 pears", "5 pears")), (2, torn)]
    got = found(decontaminate.leaks(frame(spark, docs), bench(spark, [(10, apples), (11, copy)])))
    assert brute.leaks(docs, [(10, apples), (11, copy)]) == {}
    assert got[1, 10] == (1.0, True) and got[2, 11][0].expected > 0.7 and got[2, 11][1]


def test_verbatim_copies_of_any_item(spark):
    items = [(1, "12 + 7 = 19"), (2, "3 km 5 kg 8 lb 9 cm 4 mm 6 mg 2 days 11 hours"), (3, "Paris, Rome, Berlin, Oslo, Madrid, Lisbon, Vienna, Prague, Warsaw"), (4, "名前は何ですか。今日の天気はどうですか"), (5, "What is the capital of France"), (6, "Name it")]
    docs = [(i, f"someone said that {t} and so on") for i, t in items] + [(7, "someone said nothing of note, 12 + 8 = 20")] + [(8, "ここで" + items[3][1] + "と言う")]
    got = found(decontaminate.leaks(frame(spark, docs), bench(spark, items)))
    assert set(got) == {(i, i) for i, _ in items} | {(8, 4)}
    assert set(brute.leaks(docs, items)) < set(got)
    assert not any(changed for i, (_, changed) in got.items())


def test_a_passage_of_a_long_item(spark):
    r = random.Random(2)
    words = ["".join(r.choices("abcdefgh", k=6)) for _ in range(250)]
    docs = [(1, "before it " + " ".join(words[100:160]) + " behind it"), (2, " ".join(words[100:150])), (3, " ".join(words[100:149]))]
    got = found(decontaminate.leaks(frame(spark, docs), bench(spark, [(10, " ".join(words))])))
    assert got == {(1, 10): (pytest.approx(53 / 243), False), (2, 10): (pytest.approx(43 / 243), False)}
