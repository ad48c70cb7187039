from conftest import rows
from pyspark.sql import functions as F

from skein.functions import labels
from skein.operators import relational
from skein.sources import files
from skein.streaming import envelopes


def test_file_tree_and_changes(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("x = 1")
    (tmp_path / "src" / "bin.py").write_bytes(b"\xff\xfe\x00")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "b.js").write_text(" ")
    (tmp_path / "node_modules" / "empty.js").write_text("")
    tree = files.file_tree(spark, str(tmp_path))
    got = {r["path"]: r["content"] for r in tree.collect()}
    assert got == {"src/a.py": "x = 1", "src/bin.py": None, "node_modules/b.js": " "}
    assert {r["path"] for r in files.analysed(tree).collect()} == {"src/a.py", "src/bin.py"}
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("n", None)], "path string, content string")
    new = spark.createDataFrame([("a", "1"), ("b", "x"), ("d", "3"), ("e", "9"), ("n", None)], "path string, content string")
    assert rows(files.changed_files(old, new)) == [("b", "MODIFIED", None), ("d", "RENAMED", "c"), ("e", "ADDED", None)]


def test_baselines(spark, tmp_path):
    store = files.BaselineStore(spark, str(tmp_path / "store"))
    df = spark.createDataFrame([("p", "m", f"c{i}", i, f"doc{i}") for i in (1, 2, 3)], "project string, branch string, commit string, seq int, document string")
    store.save(df)
    store.save(df.where("seq = 2"))
    doc = lambda c: [r["document"] for r in store.baseline("p", "m", c).collect()]
    assert doc("c3") == ["doc2"] and doc("c1") == [] and doc("unknown") == ["doc3"]
    files.write_json(df.where("seq = 1"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).collect()[0][0] == '{"branch":"m","commit":"c1","document":"doc1","project":"p","seq":1}'
    noisy = spark.createDataFrame([(1, '{"a":1}'), (2, "log line"), (3, '{"a":2}'), (4, "{broken"), (5, None)], "line_no int, value string")
    assert files.last_json(noisy).collect()[0][0] == '{"a":2}'


def test_stream_gate_and_dedup(spark, tmp_path):
    schema = "eventId string, eventType string, eventVersion int, received_at timestamp_ntz, correlationId string, traceId string"
    one = spark.sql("select 'aaaaaaaa-1111' as eventId, 'AnalysisFailed' as eventType, 1 as eventVersion, timestamp_ntz'2025-01-01 00:00:00' as received_at, 'c-1234567' as correlationId, 't' as traceId")
    data = one.union(one).union(one.withColumn("eventId", F.lit("short"))).union(one.withColumn("eventType", F.lit("Other"))).union(one.withColumn("eventVersion", F.lit(2))).union(one.withColumn("correlationId", F.lit("short")))
    data.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = envelopes.gate(envelopes.envelope_stream(spark, str(tmp_path / "in"), "*.parquet", one.schema))
    envelopes.route(s, str(tmp_path / "ok"), str(tmp_path / "bad"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "ok")).count() == 2
    assert sorted(r["reason"] for r in spark.read.parquet(str(tmp_path / "bad")).collect()) == ["id", "id", "type", "version"]
    u = envelopes.unique_events(envelopes.gate(envelopes.envelope_stream(spark, str(tmp_path / "in"), "*.parquet", one.schema)).where("ok"))
    u.select("eventId").writeStream.format("parquet").option("path", str(tmp_path / "u")).option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.schema("eventId string").parquet(str(tmp_path / "u")).count() == 1
    made = envelopes.make_envelope(one.withColumn("runId", F.lit("r")), "Epic1Completed").collect()[0]
    assert made["correlationId"] == "c-1234567" and made["payload"]["runId"] == "r" and len(made["eventId"]) == 36


def test_relational(spark):
    e = spark.createDataFrame([(1, "a", 3, None), (2, "a", 1, "x"), (3, "b", 2, None)], "id int, k string, o int, v string")
    assert [(r["k"], r["id"]) for r in relational.first_wins(e, ["k"], [F.col("o")]).orderBy("k").collect()] == [("a", 2), ("b", 3)]
    assert [r["c"] for r in relational.carry_forward(e, "k", [F.col("o")], "v", "c").orderBy("id").collect()] == ["x", "x", None]
    assert [r["n"] for r in relational.numbered_ids(e, "k", [F.col("id")], "n").orderBy("id").collect()] == ["a", "a_2", "b"]
    req = spark.createDataFrame([("m",), ("z",)], "request string")
    tgt = spark.createDataFrame([("m/index.js",), ("m.ts",)], "path string")
    assert sorted(rows(relational.resolve_candidates(req, tgt, "request", [".js", ".ts", "/index.js"])), key=repr) == [("m", "m.ts"), ("z", None)]
    t = spark.createDataFrame([(1, "use alpha-beta, alpha"), (2, None), (3, "alphabet")], "d int, t string")
    assert rows(relational.contained_terms(t, spark.createDataFrame([("alpha",), ("beta",)], "term string"), "d", "t", "term")) == [(1, "alpha"), (1, "beta")]
    lab = spark.createDataFrame([("/src/routes/a.js",), ("latest.md",), ("x/doc.json",)], "p string")
    assert [r[0] for r in lab.select(labels.file_category(F.col("p"))).collect()] == ["source", "test", "doc"]
    assert lab.select(labels.file_layer(F.col("p"))).collect()[0][0] == "route"


def test_registry_has_sql_for_known_queries():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "degree_metrics" in e.queries()
