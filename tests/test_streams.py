"""Streams give what the same operators give on batches."""

import json

from pyspark.sql import functions as F

from veinstone.sources import files
from veinstone.streaming import events as streams

FOLDER = "/root/testdata/sf0.001"


def streamed(spark, tmp_path, make, mode):
    batch = spark.read.parquet(f"{FOLDER}/events.parquet")
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = make(source).writeStream.format("memory").queryName("found").outputMode(mode).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return batch, spark.table("found")


def test_windows(spark, tmp_path):
    batch, found = streamed(spark, tmp_path, lambda s: streams.tumbling_counts(s), "complete")
    columns = ["start", "event_type", "events"]
    assert sorted(map(str, found.select(columns).collect())) == sorted(map(str, streams.tumbling_counts(batch).select(columns).collect()))


def test_sessions(spark, tmp_path):
    batch, found = streamed(spark, tmp_path, lambda s: streams.idle_sessions(s, late="100 days"), "complete")
    assert sorted(map(str, found.collect())) == sorted(map(str, streams.idle_sessions(batch).collect()))


def test_stage_updates(spark, tmp_path):
    named = lambda s: streams.current_stage(s.select(F.col("user_id").alias("doc_id"), "ts", F.lit("chunking").alias("stage")))
    _, found = streamed(spark, tmp_path, named, "complete")
    assert {r.stage for r in found.collect()} == {"chunking"}


def test_patches_and_sink(spark, tmp_path):
    parts = spark.createDataFrame([("t", 1, "b\n---\n"), ("t", 0, "a"), ("u", 0, "c")], "task_id string, seq int, patch string")
    assert {(r.task_id, r.text, r.closed) for r in streams.patches(parts).collect()} == {("t", "ab\n---\n", True), ("u", "c", False)}
    seen = []
    parts.write.parquet(str(tmp_path / "p"))
    source = spark.readStream.schema(parts.schema).parquet(str(tmp_path / "p"))
    streams.publish(source, lambda df, k: seen.append(df.count()), str(tmp_path / "c")).awaitTermination(60)
    assert sum(seen) == 3


def test_kept_turns(spark, tmp_path):
    schema = "session string, turn long, user string, assistant string"
    spark.createDataFrame([(f"s{k % 3}", k, f"u{k}", "a") for k in range(60)], schema).repartition(4).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(str(tmp_path / "in"))
    query = streams.kept_turns(source, 10).writeStream.format("memory").queryName("kept").outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    found = {r.session: [json.loads(t)[0] for t in r.turns] for r in spark.table("kept").collect()}
    assert found == {f"s{k}": [n for n in range(60) if n % 3 == k][-10:] for k in range(3)}


def test_idle_alerts(spark, tmp_path):
    rows = [("a", 0), ("a", 300), ("b", 100), ("c", 5000), ("c", 90_000)]
    events = spark.createDataFrame(rows, "key string, s long").select("key", F.timestamp_seconds("s").alias("ts"))
    events.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = streams.idle_alerts(source).writeStream.format("memory").queryName("idle").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {(r.key, r.events) for r in spark.table("idle").collect()} == {("a", 2), ("b", 1), ("c", 1)}


def test_ask_and_reply_streams(spark, tmp_path):
    asks = spark.createDataFrame([("q1", 0), ("q2", 10), ("q3", 100_000)], "ask_id string, s long").select("ask_id", F.timestamp_seconds(F.col("s") + 10**9).alias("ts"))
    replies = spark.createDataFrame([("q1", 200, "yes"), ("q2", 900, "late"), ("q3", 100_100, "ok")], "ask_id string, s long, reply string").select("ask_id", F.timestamp_seconds(F.col("s") + 10**9).alias("ts"), "reply")
    expected = {(r.ask_id, r.reply) for r in streams.answered(asks, replies).collect()}
    assert expected == {("q1", "yes"), ("q2", None), ("q3", "ok")}
    sources = []
    for name, df in (("asks", asks), ("replies", replies)):
        df.write.parquet(str(tmp_path / name))
        sources.append(spark.readStream.schema(df.schema).parquet(str(tmp_path / name)))
    query = streams.answered(*sources).writeStream.format("memory").queryName("said").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    said = {(r.ask_id, r.reply) for r in spark.table("said").collect()}
    assert said <= expected and {("q1", "yes"), ("q3", "ok")} <= said


def test_repeats_and_means_of_streams(spark, tmp_path):
    make = lambda s: streams.without_repeats(s.select("user_id", "event_type", "ts"), ["user_id", "event_type"], "100 days")
    batch, found = streamed(spark, tmp_path, make, "append")
    keys = lambda df: sorted((r.user_id, r.event_type) for r in df.collect())
    assert keys(found) == keys(batch.select("user_id", "event_type").distinct())
    (tmp_path / "two").mkdir()
    batch, found = streamed(spark, tmp_path / "two", lambda s: streams.sliding_means(s).withColumn("mean", F.round("mean", 6)), "complete")
    assert sorted(map(str, found.collect())) == sorted(map(str, streams.sliding_means(batch).withColumn("mean", F.round("mean", 6)).collect()))


def test_csv_and_encoding(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n3\n4,5,6\n")
    assert sorted((r.x, r.y) for r in files.csv_rows(spark, str(tmp_path / "a.csv")).collect()) == [("1", "2"), ("3", None)]
    (tmp_path / "g.txt").write_bytes("马氏体".encode("gbk"))
    assert files.sniffed(b"abc", lambda head: "ascii") == "ascii" and files.sniffed(b"abc") == "utf-8" and files.sniffed(bytes([0xFF, 0xFE, 0x81])) in ("big5", "gbk", "gb18030", "latin-1")
    found = files.contents(spark, str(tmp_path), "g.txt").select(files.encoding(F.col("content")).alias("e"), files.is_workbook(F.col("content")).alias("w")).first()
    assert (found.e, found.w) == ("gbk", False)
    old = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k int, seq int, v string")
    new = spark.createDataFrame([(1, 0, "c")], "k int, seq int, v string")
    assert {(r.k, r.v) for r in files.upsert(old, new, ["k"], "seq").collect()} == {(1, "c"), (2, "b")}
