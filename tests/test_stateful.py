"""Streams with state and timers of their own, and topics."""

import random
import time

import pytest

from veinstone.streaming import stateful, topics


def frames(spark, tmp_path, rows, schema, files, order=None):
    """A stream of the rows, some of them in each micro-batch."""
    size = -(-len(rows) // files)
    for k in range(files):
        part = spark.createDataFrame(rows[k * size : (k + 1) * size], schema).coalesce(1)
        part.write.mode("append").parquet(f"file://{tmp_path}/in")
        time.sleep(0.02)  # files are taken by age
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"file://{tmp_path}/in")


TURNS = "session string, ts timestamp_ltz, turn long, user string, assistant string"


def test_session_queue_keeps_order_and_the_last_ten(spark, tmp_path):
    rng = random.Random(1)
    rows = [(f"s{k % 3}", 1000 + k, k, f"u{k}", "a") for k in range(90)]
    blocks = [rows[k : k + 15] for k in range(0, 90, 15)]
    for block in blocks:
        rng.shuffle(block)
    shuffled = [row for block in blocks for row in block]
    source = frames(spark, tmp_path, [(s, str(_at(ts)), t, u, a) for s, ts, t, u, a in shuffled], TURNS.replace("timestamp_ltz", "string"), 6)
    _until(spark, stateful.started(spark, stateful.session_queue(source, 10), "queue", f"file://{tmp_path}/state", every="100 milliseconds"), "queue", 90)
    found = spark.table("queue").where("event = 'served'").collect()
    for s in range(3):
        own = sorted((r for r in found if r.session == f"s{s}"), key=lambda r: r.nth)
        turns = [k for k in range(90) if k % 3 == s]
        assert [r.turn for r in own] == turns and [r.nth for r in own] == list(range(1, 31))
        assert all(list(r.turns) == turns[max(0, i - 9) : i + 1] and r.kept == len(r.turns) for i, r in enumerate(own))


def _until(spark, query, name, rows, batches=1):
    """Stops a query, which runs on for its timers, once its table has so many rows and it has seen so many files."""
    end = time.time() + 90
    try:
        while time.time() < end and (spark.table(name).count() < rows or sum(p["numInputRows"] > 0 for p in query.recentProgress) < batches):
            time.sleep(0.3)
    finally:
        query.stop()


def _at(seconds):
    import datetime

    return datetime.datetime.fromtimestamp(seconds, datetime.timezone.utc).replace(tzinfo=None)


def test_session_queue_expires_after_half_an_hour(spark, tmp_path):
    minute = 60
    rows = [("a", 0, 1), ("b", minute, 1), ("b", 20 * minute, 2), ("a", 100 * minute, 2), ("c", 400 * minute, 1), ("c", 401 * minute, 2)]
    source = frames(spark, tmp_path, [(s, str(_at(86_400 + ts)), t, "u", "a") for s, ts, t in rows], TURNS.replace("timestamp_ltz", "string"), 6)
    query = stateful.started(spark, stateful.session_queue(source, 10, clock="event"), "expiry", f"file://{tmp_path}/state")
    query.awaitTermination(180)
    found = spark.table("expiry").collect()
    served = {(r.session, r.turn): (r.nth, list(r.turns)) for r in found if r.event == "served"}
    assert served[("b", 2)] == (2, [1, 2]) and served[("a", 2)] == (1, [2])  # twenty minutes go on, a hundred begin again
    assert sorted((r.session, r.nth) for r in found if r.event == "expired") == [("a", 1), ("a", 1), ("b", 2)]


def test_watchdog_alerts_although_nothing_comes(spark, tmp_path):
    rows = [("x", str(_at(5))), ("x", str(_at(9))), ("y", str(_at(7)))]
    source = frames(spark, tmp_path, rows, "key string, ts string", 1)
    _until(spark, stateful.started(spark, stateful.watchdog(source, 1500), "alerts", f"file://{tmp_path}/state", "update", "300 milliseconds"), "alerts", 2)
    assert sorted((r.key, r.events) for r in spark.table("alerts").collect()) == [("x", 2), ("y", 1)]


def patches(seed):
    rng = random.Random(seed)
    rows, kinds = [], ["word ", "more\n", "---", "\n", "\n---\n", "```", "```py\n", "tail", " "]
    for task in range(25):
        rows += [(f"t{task}", seq, rng.choices(kinds, [8, 4, 1, 2, 1, 1, 1, 4, 2])[0]) for seq in range(rng.randrange(1, 14))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [3, 4])
def test_patches_close_as_in_a_batch(spark, tmp_path, seed):
    rows, schema = patches(seed), "task_id string, seq int, patch string"
    source = frames(spark, tmp_path, rows + rows[:5], schema, 5)
    batch = {(r.task_id, r.text) for r in stateful.closed_texts(spark.createDataFrame(rows, schema)).collect() if r.closed}
    _until(spark, stateful.started(spark, stateful.closing_patches(source), f"closed{seed}", f"file://{tmp_path}/state", "update", "100 milliseconds"), f"closed{seed}", len(batch), 5)
    assert batch and sorted((r.task_id, r.text) for r in spark.table(f"closed{seed}").collect()) == sorted(batch)


def test_closed_texts_end_where_they_close(spark):
    rows = [("a", 0, "x\n--"), ("a", 1, "-\ny"), ("a", 2, "late"), ("b", 0, "```py\n"), ("b", 1, "code\n```\n "), ("b", 2, "late"), ("c", 0, None), ("c", 1, "open")]
    found = {r.task_id: (r.text, r.closed) for r in stateful.closed_texts(spark.createDataFrame(rows, "task_id string, seq int, patch string")).collect()}
    assert found == {"a": ("x\n---\ny", True), "b": ("```py\ncode\n```\n ", True), "c": ("open", False)}


def test_topics_have_no_replay_and_go_on_after_a_restart(spark, tmp_path):
    topics.register(spark)
    folder = f"file://{tmp_path}/topics"
    published = 0

    def publish(payloads, writer="one"):
        nonlocal published
        published += 1
        spark.createDataFrame([("chat", p) for p in payloads], topics.SCHEMA).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/{writer}")
        rows = spark.readStream.schema(topics.SCHEMA).parquet(f"file://{tmp_path}/{writer}")
        query = rows.writeStream.format("topic").option("path", folder).option("topic", "chat").option("writer", writer).option("checkpointLocation", f"file://{tmp_path}/{writer}-state").trigger(availableNow=True).start()
        query.awaitTermination(120)

    def subscribe(name, round_):
        rows = spark.readStream.format("topic").option("path", folder).option("topic", "chat").load()
        return rows.writeStream.foreachBatch(lambda df, _: got[name].extend(r.payload for r in df.collect())).option("checkpointLocation", f"file://{tmp_path}/sub-{name}").trigger(processingTime="200 milliseconds").start()

    def until(name, n):
        end = time.time() + 60
        while time.time() < end and len(got[name]) < n:
            time.sleep(0.2)

    got = {"early": [], "late": []}
    publish(["before"])
    early = subscribe("early", 1)
    _begun(early)
    publish(["one", "two"])
    until("early", 2)
    late = subscribe("late", 1)
    _begun(late)
    publish(["three"], "other")
    until("early", 3), until("late", 1)
    early.stop()
    publish(["four"])
    until("late", 2)
    early = subscribe("early", 2)
    until("early", 4)
    early.stop(), late.stop()
    assert got == {"early": ["one", "two", "three", "four"], "late": ["three", "four"]}
    assert topics.swept(folder, "chat") == 2 and topics.swept(folder, "chat") == 0


def _begun(query):
    """Waits for a subscriber's first offset."""
    end = time.time() + 60
    while time.time() < end and not query.status["message"].startswith("Waiting"):
        time.sleep(0.2)
    time.sleep(1)


def test_topic_needs_a_place(spark):
    topics.register(spark)
    with pytest.raises(Exception, match="path and topic"):
        spark.readStream.format("topic").load().writeStream.format("noop").option("checkpointLocation", "file:///tmp/none").start().awaitTermination(15)
