import datetime as dt
from collections import defaultdict

from conftest import rows

from skein.operators.dedup import RunStore, distinct_messages, surplus_deliveries

SCHEMA = "delivery_id long, batch_id string, received_at timestamp_ntz, eventId string, correlationId string, _key string, payload string"
U = "05471056-b8bd-4f0a-89fb-c430e7d17486"


def day(n):
    return dt.datetime(2025, 1, n)


def make(spark, data):
    return spark.createDataFrame([(i, b, t, e, c, "clash", "x") for i, b, t, e, c in data], SCHEMA)


def test_spellings_order_and_unusable_ids(spark):
    data = [
        (1, "a", day(2), U, "c"),
        (2, "b", day(1), U.upper(), "c"),
        (3, "b", day(1), "{" + U + "}", "c"),
        (4, None, day(3), "urn:uuid:" + U, "c"),
        (5, "a", day(3), " " + U.replace("-", "") + " ", "c"),
        (6, "a", day(1), U, "other"),
        (7, "a", day(1), None, "c"),
        (8, "a", day(1), None, "c"),
        (9, "a", day(1), "n/a", "c"),
        (10, "a", day(1), "n/a", "c"),
        (11, "a", None, U, "other"),
        (12, "a", day(1), U, None),
        (13, "a", day(2), U, None),
    ]
    assert rows(surplus_deliveries(make(spark, data))) == [(1,), (11,), (13,), (3,), (4,), (5,)]
    assert len(rows(distinct_messages(make(spark, data)))) == 7


def test_empty_table(spark):
    assert rows(surplus_deliveries(make(spark, []))) == []


def test_hot_identifier(spark):
    data = [(i, str(i % 7), day(1 + i % 3), U if i % 3 else f"{i:032x}", "c") for i in range(600)]
    best = defaultdict(list)
    for i, _, t, e, c in data:
        best[e].append((t, i))
    want = sorted((i,) for v in best.values() for _, i in sorted(v)[1:])
    assert sorted(rows(surplus_deliveries(make(spark, data)))) == want


def test_store_is_idempotent_over_batches(spark):
    df = spark.createDataFrame([("k", 2, "late"), ("k", 1, "early"), ("j", 5, "only")], "k string, o int, v string").withColumn("run", __import__("pyspark").sql.functions.lit(0))
    store = RunStore(spark, ["k"], ["o"], 2)
    once = rows(store.upsert(df, "run").compact().select("k", "o", "v"))
    again = rows(store.upsert(df, "run").compact().select("k", "o", "v"))
    assert once == again == [("j", 5, "only"), ("k", 1, "early")]


def test_store_is_opened_again_and_rewritten(spark):
    from skein.operators.dedup import RunStore

    first = spark.createDataFrame([("k1", 5, "a", 0), ("k2", 3, "b", 0), ("k1", 4, "c", 1)], "k string, o int, v string, run int")
    later = spark.createDataFrame([("k1", 2, "d", 2), ("k3", 1, "e", 2), ("k2", 9, "f", 2)], "k string, o int, v string, run int")
    store = RunStore(spark, ["k"], ["o"], 3).upsert(first, "run")
    store.close()
    again = RunStore(spark, ["k"], ["o"], path=store.path)
    again.upsert(later, "run").upsert(later, "run")
    want = [("k1", 2, "d"), ("k2", 3, "b"), ("k3", 1, "e")]
    got = lambda s: sorted((r["k"], r["o"], r["v"]) for r in s.compact().collect())
    assert again.buckets == 3 and got(again) == want
    plan = again.compact()
    again.close()
    assert plan.count() == 3 and not spark.catalog.tableExists(again.name)
    third = RunStore(spark, ["k"], ["o"], path=store.path)
    one = third.rewrite()
    third.drop()
    assert got(one) == want
    one.drop()
    assert not RunStore(spark, ["k"], ["o"], path=store.path)._written
