"""Sharding by balanced label propagation.

Documents of equal texts are linked, through a node for each text rather than in pairs. Documents begin in random
shards. In each round every text is drawn to the shard where most of its bytes are, among those with room, and its
documents follow where that holds more of the text than their own shard does; where more bytes want to enter a shard
than fit, each is admitted with the chance that fits on average, so that a round is two aggregations and a join and
no shard has a queue. A text larger than a shard so fills one shard after another. Documents without links come last
and make the sizes even: sorted by descending size, they are dealt along their running total in laps, each of which
fills a part of what the shards lack, so that the last and smallest even out what larger ones left.

The law is ``bytes``: sizes of shards are near equal. Null texts count as empty, of size 1, and are linked to empty
ones. Null ids are ordinary values, and rows that repeat an id are documents of their own. Columns besides id and text
are ignored. Slots number the documents of a shard from 0 without gaps, through counts of buckets, in no task alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veinstone.llm.common import crc32, shuffle_width, skew_safe_lookup, table, written

SHARDS, ROUNDS, LAPS = 8, 5, 7
#: Rounds end once fewer than this share of the linked bytes moves.
STILL = 0.002


def _chance(salt: str) -> Column:
    """Uniform in [0, 1), the same for a document on every run."""
    return F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(1 << 20)) / F.lit(float(1 << 20))


def _digested(nodes: DataFrame) -> DataFrame:
    """nodes (doc_id, group, ...) with ``row``, a digest of id, text and number among rows that are equal in both.

    Equal rows are counted by partition first, so that no task has all of them. Which of them has which number doesn't
    matter: they are alike.
    """
    nodes = nodes.withColumns({"same": F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.hex("group")).cast("binary"))), "part": F.spark_partition_id()})
    nodes = written(nodes, "shards-equal")
    counts = nodes.groupBy("same", "part").agg(F.count("*").alias("n"))
    by_same = Window.partitionBy("same")
    counts = counts.withColumns({"all": F.sum("n").over(by_same), "earlier": F.sum("n").over(by_same.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))})
    repeated = counts.where("all > 1").select("same", "part", F.coalesce("earlier", F.lit(0)).alias("earlier"))
    joined = nodes.join(repeated, ["same", "part"], "left")
    nth = F.col("earlier") + F.row_number().over(Window.partitionBy("same", "part").orderBy("same"))
    return joined.withColumn("row", F.xxhash64("same", F.coalesce(nth, F.lit(0).cast("long")))).drop("same", "part", "earlier")


def _by_number(values: dict[int, float], of: Column) -> Column:
    return F.array(*(F.lit(float(values.get(s, 0.0))) for s in range(len(values))))[of]


def propagate(linked: DataFrame, capacity: float, shards: int, rounds: int = ROUNDS) -> DataFrame:
    """Moves linked documents (doc_id, size, text_crc32, row, group, shard) towards the shards of their groups."""
    for k in range(rounds):
        loads = {row["shard"]: row["bytes"] for row in linked.groupBy("shard").agg(F.sum("size").alias("bytes")).collect()}  # a row for each shard
        room = {s: max(0.0, capacity - loads.get(s, 0)) for s in range(shards)}
        held = linked.groupBy("group", "shard").agg(F.sum("size").alias("bytes"), F.count("*").alias("documents"))
        open_shard = _by_number(room, F.col("shard")) > 0
        pull = held.groupBy("group").agg(
            F.sum("documents").alias("documents"),
            F.max_by(F.when(open_shard, F.col("shard")), F.when(open_shard, F.struct(F.col("bytes"), -F.col("shard")))).alias("best"),
            F.max(F.when(open_shard, F.col("bytes"))).alias("drawn"),
            F.map_from_entries(F.collect_list(F.struct("shard", "bytes"))).alias("bytes_in"),  # a row for each shard at most
        )
        wanting = skew_safe_lookup(linked, pull, "group", "documents", F.col("row")).withColumn("wants", F.coalesce((F.col("best") != F.col("shard")) & (F.col("drawn") >= F.col("bytes_in")[F.col("shard")]), F.lit(False)))
        wanting = written(wanting.select(*linked.columns, "best", "wants"), "shards-wanting")
        demand = {row["best"]: row["bytes"] for row in wanting.where("wants").groupBy("best").agg(F.sum("size").alias("bytes")).collect()}
        if sum(demand.values()) <= STILL * sum(loads.values()):
            return linked
        admitted = {s: min(1.0, room[s] / demand[s]) if demand.get(s) else 0.0 for s in range(shards)}
        moves = F.col("wants") & (_chance(f"round {k}") < _by_number(admitted, F.col("best")))
        linked = wanting.withColumn("shard", F.when(moves, F.col("best")).otherwise(F.col("shard"))).select(linked.columns)
        # Fixed before loads are read again.
        linked = written(linked, "shards-round")
    return linked


def _running(rows: DataFrame, order: list[Column], value: str) -> DataFrame:
    """rows with ``before``, the total of value over all rows earlier in the order; no task holds them all."""
    ordered = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "shards-order")
    totals = {row["part"]: row["n"] for row in ordered.groupBy("part").agg(F.sum(value).alias("n")).collect()}  # a row for each partition
    offsets, total = [], 0
    for part in sorted(totals):
        offsets.append((part, total))
        total += totals[part]
    offsets = rows.sparkSession.createDataFrame(offsets or [(-1, 0)], "part int, offset long")
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return ordered.withColumn("before", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(F.broadcast(offsets), "part").withColumn("before", F.col("before") + F.col("offset")).drop("part", "offset")


def deal(single: DataFrame, loads: dict[int, int], shards: int, laps: int = LAPS) -> DataFrame:
    """Gives each unlinked document a shard, so that loads become even."""
    single = written(_running(single, [F.desc("size"), F.asc_nulls_last("doc_id"), F.asc("row")], "size"), "shards-running")
    total = single.agg(F.sum("size").alias("n")).first()["n"] or 0
    middle = F.col("before") + F.col("size") / 2
    shard, start = F.lit(0), 0.0
    even = (total + sum(loads.values())) / shards
    for lap in range(laps):
        end = total * (1 - 0.5 ** (lap + 1)) if lap + 1 < laps else total + 1.0
        lacks = [max(0.0, even - loads.get(s, 0)) for s in range(shards)]
        each = (end - start) / (sum(lacks) or 1.0)
        cut = F.lit(shards - 1)
        ends, at = [], start
        for s in range(shards):
            at += lacks[s] * each
            ends.append(at)
        last = max((s for s in range(shards) if lacks[s]), default=shards - 1)
        for s in range(shards - 1, -1, -1):
            cut = F.when(middle < ends[s], F.lit(s)).otherwise(cut if s < last else F.lit(last))
        inside = (middle >= start) & (middle < end)
        shard = F.when(inside, cut).otherwise(shard)
        got = single.where(inside).groupBy(cut.alias("shard")).agg(F.sum("size").alias("n")).collect()  # a row for each shard
        for row in got:
            loads[row["shard"]] = loads.get(row["shard"], 0) + row["n"]
        start = end
    return single.withColumn("shard", shard.cast("int"))


def numbered(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """rows with a gapless number from 0 within each group; rows: a table that reads the same each time."""
    buckets = shuffle_width(rows.sparkSession) * 4
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    earlier = Window.partitionBy(group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(group, "bucket").agg(F.count("*").alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    inside = Window.partitionBy(group, "bucket").orderBy(*order)
    # counts: shards x buckets rows.
    return rows.withColumn("nth", F.row_number().over(inside)).join(F.broadcast(counts), [group, "bucket"]).withColumn(name, F.col("offset") + F.col("nth") - 1).drop("bucket", "nth", "offset")


def shard_documents(docs: DataFrame, shards: int = SHARDS, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every document."""
    text = F.coalesce(docs[text_column].cast("string"), F.lit(""))
    nodes = docs.select(
        docs[id_column].cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), crc32(text).alias("text_crc32"),
        F.substring(F.unhex(F.sha2(text, 256)), 1, 16).alias("group"),
    )
    nodes = written(_digested(nodes), "shards-nodes")
    groups = nodes.groupBy("group").agg(F.count("*").alias("documents"))
    grouped = written(skew_safe_lookup(nodes, groups, "group", "documents", F.col("row")), "shards-grouped")
    first = F.floor(_chance("first") * shards).cast("int")
    linked = written(grouped.where("documents > 1").drop("documents").withColumn("shard", first), "shards-linked")
    single = grouped.where("documents = 1").drop("documents", "group")
    total = nodes.agg(F.sum("size").alias("n")).first()["n"] or 0
    capacity = total / shards
    linked = propagate(linked, capacity, shards)
    over = {row["shard"]: row["bytes"] for row in linked.groupBy("shard").agg(F.sum("size").alias("bytes")).collect()}
    # What chance has put above the capacity joins the unlinked documents.
    excess = {s: max(0.0, over.get(s, 0) - capacity) / over[s] if over.get(s) else 0.0 for s in range(shards)}
    out = _chance("over") < _by_number({s: x and 1.1 * x + 1e-3 for s, x in excess.items()}, F.col("shard"))
    single = single.unionByName(linked.where(out).drop("group", "shard"))
    linked = linked.where(~out).drop("group")
    loads = {row["shard"]: row["n"] for row in linked.groupBy("shard").agg(F.sum("size").alias("n")).collect()}
    placed = written(linked.unionByName(deal(single, loads, shards).select(linked.columns)), "shards-placed")
    return numbered(placed, "shard", ["doc_id", "text_crc32", "row"], "slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def measures(placed: DataFrame, group: str = "text_crc32") -> DataFrame:
    """(imbalance, cut, links): the largest shard over the mean less 1, and how many of the links between documents of a group are cut.

    placed: (shard, size, group). Links are counted from a group's numbers in each shard, not as pairs.
    """
    loads = placed.groupBy("shard").agg(F.sum("size").alias("bytes"))
    groups = placed.groupBy(group, "shard").agg(F.count("*").alias("n")).groupBy(group).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("squares"))
    links = groups.agg(F.coalesce(F.sum((F.col("n") * F.col("n") - F.col("squares")) / 2), F.lit(0.0)).alias("cut"), F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0.0)).alias("links"))
    return loads.agg((F.max("bytes") / F.avg("bytes") - 1).alias("imbalance")).crossJoin(links)  # a row each


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
