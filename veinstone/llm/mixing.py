"""Mixing sources to target weights.

Sources, in code point order with null last, get the weights 1, 2, 3, repeating, of all words; a target stops at MOST
times the source's words, and what it would have above that is shared again by weight. Documents are put in random order by a
digest of id and text and cut into blocks of that order. A source is taken in passes: each pass draws its blocks in a
permutation of its own, whole passes all of them, and a last one until the target is met, where one block is cut. So a source's
exact quota is a number of blocks.

Output shards get equal numbers of blocks. A splitting tree halves the shards at each level, and at each node the quotas
of the sources are divided between both halves by a multivariate hypergeometric draw, source by source, each conditional
on those before it; the leaves are exact quotas of every shard, distributed as if all blocks had been shuffled. The shards
draw their quotas one after the other from the permuted blocks of the source, so that their draws are disjoint, and a copy of
a document is taken by the shard that draws its block. Each shard is shuffled locally, by a digest of document and copy.

Of the block that is cut, documents are drawn as long as they fit. Up to FILLS documents that the last pass has not drawn, each
the largest that fits in what is left, then close the gap to the target.

All of it is DataFrame expressions. The text is looked at once; what follows works on id, source, size and place. The tree
works on counts: a row for each node, with an array over the sources, whose number (some thousands) is taken to be bounded.
Blocks and sources are broadcast only if they are BROADCAST_ROWS at most, and else joined by shuffle, by source and
block, so that a source with most of the documents is spread over BLOCKS keys.

A null text counts as empty (0 words), and a null source is a source. Rows that are equal in id and text share their place
in the order, and are drawn together. A source without words has target 0, and nothing of it is taken. Reruns agree.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veinstone.llm.common import SPACES, table, written

BLOCKS, SHARDS, MOST, FILLS = 1024, 8, 3, 6
#: Bits of the digest that order documents; the leading ones are the block, those after them the part of a block.
BITS, PARTS = 52, 1024
_BLOCK_BITS, _PART_BITS = int(math.log2(BLOCKS)), int(math.log2(PARTS))
#: Rows of a table by source or block that may be broadcast.
BROADCAST_ROWS = 200_000


def _digest(*parts: Column) -> Column:
    """52 bits of MD5, as a long."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(p.cast("string") for p in parts)).cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def word_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")).cast("long")


def source_targets(blocks: DataFrame) -> DataFrame:
    """(source, nth, source_size, target, whole, rest) from blocks (source, block, words): rows for sources only."""
    sources = blocks.groupBy("source").agg(F.sum("words").alias("source_size"))
    nth = F.row_number().over(Window.orderBy(F.asc_nulls_last("source")))
    sources = sources.withColumn("nth", nth).withColumn("weight", ((F.col("nth") - 1) % 3 + 1).cast("double"))
    sources = sources.withColumn("cap", (F.col("source_size") * MOST).cast("double"))
    # Water-filling: the sources with the least cap for their weight stop first.
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("weight"), "nth").rowsBetween(Window.unboundedPreceding, -1)
    sources = sources.withColumns({
        "level": (F.sum("source_size").over(everything).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))),
    })
    # The first level that a source doesn't reach the cap of holds for all later ones.
    stops = F.col("cap") <= F.col("level") * F.col("weight")
    sources = sources.withColumn("common", F.min(F.when(~stops, F.struct(F.col("cap") / F.col("weight"), "nth", "level"))).over(everything)["level"])
    sources = sources.withColumn("target", F.when(stops, F.col("cap")).otherwise(F.col("common") * F.col("weight")))
    size = F.col("source_size")
    sources = sources.withColumn("whole", F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0).cast("int"))
    return sources.select("source", "nth", "source_size", "target", "whole", (F.col("target") - F.col("whole") * size).alias("rest"))


def _log_factorial(x: Column) -> Column:
    small = F.get(F.array(*(F.lit(math.lgamma(k + 1)) for k in range(10))), F.least(x, F.lit(9)).cast("int"))
    y = F.greatest(x, F.lit(9)).cast("double")
    series = (y + 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y)
    return F.when(x < 10, small).otherwise(series)


def hypergeometric(u: Column, everything: Column, marked: Column, drawn: Column) -> Column:
    """The number of marked among ``drawn`` of ``everything``, at the quantile u; values beyond 12 deviations are left out."""
    lowest, highest = F.greatest(F.lit(0), drawn - (everything - marked)), F.least(marked, drawn)
    share = marked / F.greatest(everything, F.lit(1))
    mean = drawn * share
    spread = 12 * F.sqrt(mean * (1 - share) + 1) + 1
    low = F.greatest(lowest, F.floor(mean - spread)).cast("long")
    high = F.least(highest, F.ceil(mean + spread)).cast("long")
    fixed = _log_factorial(marked) + _log_factorial(everything - marked) + _log_factorial(drawn) + _log_factorial(everything - drawn) - _log_factorial(everything)

    def step(state: Column, k: Column) -> Column:
        chance = F.exp(state["fixed"] - _log_factorial(k) - _log_factorial(marked - k) - _log_factorial(drawn - k) - _log_factorial(everything - marked - drawn + k))
        return F.when(state["reached"] >= u, state).otherwise(F.struct(state["fixed"].alias("fixed"), (state["reached"] + chance).alias("reached"), k.alias("value")))

    start = F.struct(fixed.alias("fixed"), F.lit(0.0).alias("reached"), low.alias("value"))
    return F.aggregate(F.sequence(low, high), start, step, lambda state: state["value"])


def shard_quotas(quotas: DataFrame, shards: int) -> DataFrame:
    """(nth, ends): for each source the running total of its blocks over the shards; quotas: (nth, n).

    A row of the tree has first and last shard, and an array of (nth, n) by source.
    """
    spark = quotas.sparkSession
    nodes = quotas.agg(F.sort_array(F.collect_list(F.struct(F.col("nth"), F.col("n").cast("long").alias("n")))).alias("n")).select(F.lit(0).alias("first"), F.lit(shards).alias("end"), "n")
    counts_type = "array<struct<nth:int,n:bigint>>"
    for _ in range(max(0, math.ceil(math.log2(shards)))):
        middle = F.floor((F.col("first") + F.col("end")) / 2).cast("int")
        everything = F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x["n"])
        # The left half's share of the blocks; what doesn't divide goes left or right by shard, at most one block each.
        left_total = F.ceil(everything * (middle - F.col("first")) / (F.col("end") - F.col("first"))).cast("long")
        start = F.struct(everything.alias("all"), left_total.alias("drawn"), F.lit([]).cast(counts_type).alias("left"))

        def step(state: Column, x: Column) -> Column:
            u = _digest(F.lit("tree"), F.col("first"), F.col("end"), x["nth"]) / F.lit(float(1 << BITS))
            taken = hypergeometric(u, state["all"], x["n"], state["drawn"])
            # ``taken`` is used three times, and is evaluated once as the element of an array.
            return F.get(F.transform(F.array(taken), lambda k: F.struct((state["all"] - x["n"]).alias("all"), (state["drawn"] - k).alias("drawn"), F.array_append(state["left"], F.struct(x["nth"].alias("nth"), k.alias("n"))).alias("left"))), F.lit(0))

        nodes = nodes.withColumn("left", F.aggregate("n", start, step, lambda state: state["left"]))
        right = F.zip_with("n", "left", lambda a, b: F.struct(a["nth"].alias("nth"), (a["n"] - b["n"]).alias("n")))
        halves = F.array(
            F.struct(F.col("first"), middle.alias("end"), F.col("left").alias("n")),
            F.struct(middle.alias("first"), F.col("end"), right.alias("n")),
        )
        whole = F.array(F.struct("first", "end", F.col("n")))
        nodes = nodes.select(F.explode(F.when(F.col("end") - F.col("first") > 1, halves).otherwise(whole)).alias("node")).select("node.*")
        nodes = written(nodes, "mixing-tree")
    leaves = nodes.select(F.col("first").alias("shard"), F.explode("n").alias("q")).select("shard", "q.nth", "q.n")
    running = F.sum("n").over(Window.partitionBy("nth").orderBy("shard"))
    return leaves.withColumn("upto", running).groupBy("nth").agg(F.sort_array(F.collect_list("upto")).alias("ends"))


def _same_source(name: str) -> Column:
    return F.col("source").eqNullSafe(F.col(name))


def _drawn(blocks: DataFrame, sources: DataFrame, held: Callable[[DataFrame], DataFrame], shards: int) -> DataFrame:
    """(nth, block, copy, cut, before, shard): every block that a pass draws, and the shard that draws it."""
    each = blocks.join(held(sources.withColumnRenamed("source", "_source")), _same_source("_source")).select("nth", "block", "words", "whole", "rest")
    each = each.withColumn("blocks", F.count("*").over(Window.partitionBy("nth")))  # of BLOCKS rows at most
    last = F.col("whole") + (F.col("rest") > 0).cast("int")
    each = each.where(last > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), last)))
    order = Window.partitionBy("nth", "copy").orderBy(_digest(F.col("nth"), F.col("block"), F.col("copy"), F.lit("draw")), "block")
    each = each.withColumns({"place": F.row_number().over(order) - 1, "before": F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    partial, after = F.col("copy") > F.col("whole"), F.col("before") + F.col("words")
    cut = partial & (F.col("before") < F.col("rest")) & (after > F.col("rest"))
    each = each.withColumn("cut", cut).where(~partial | (after <= F.col("rest")) | F.col("cut"))
    each = written(each.select("nth", "block", "copy", "cut", "before", ((F.col("copy") - 1) * F.col("blocks") + F.col("place")).cast("long").alias("draw")), "mixing-drawn")
    ends = shard_quotas(each.groupBy("nth").agg(F.count("*").alias("n")), shards)
    # A draw beyond a source's quota would be in no shard; quotas are exact, so there is none.
    shard = F.size(F.filter("ends", lambda end: end <= F.col("draw")))
    return written(each.join(held(ends), "nth").withColumn("shard", shard).where(F.col("shard") < shards).drop("draw", "ends"), "mixing-shards")


def _cutoffs(narrow: DataFrame, drawn: DataFrame, sources: DataFrame, held: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(nth, cutoff, gap, last_shard): of the block that is cut, documents below a place are drawn, which leaves a gap.

    First the part of the block is found in which the target is met, then the place, so that no task has all rows of a block.
    """
    cut = drawn.where("cut").join(held(sources), "nth").select("nth", F.col("source").alias("_source"), F.col("block").alias("_block"), (F.col("rest") - F.col("before")).alias("room"), F.col("shard").alias("last_shard"))
    inside = narrow.join(held(cut), _same_source("_source") & (F.col("block") == F.col("_block")))
    inside = inside.withColumn("part", F.shiftright("place", BITS - _BLOCK_BITS - _PART_BITS))
    along = Window.partitionBy("nth").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = inside.groupBy("nth", "part").agg(F.sum("size").alias("words"), F.first("room").alias("room"), F.first("last_shard").alias("last_shard"))
    parts = parts.withColumn("before", F.coalesce(F.sum("words").over(along), F.lit(0))).where((F.col("before") <= F.col("room")) & (F.col("before") + F.col("words") > F.col("room")))
    met = parts.select(F.col("nth").alias("_nth"), F.col("part").alias("_part"), (F.col("room") - F.col("before")).alias("left"))
    places = inside.join(held(met), (F.col("nth") == F.col("_nth")) & (F.col("part") == F.col("_part"))).groupBy("nth", "place").agg(F.sum("size").alias("words"), F.first("left").alias("left"), F.first("last_shard").alias("last_shard"))
    upto = F.sum("words").over(Window.partitionBy("nth").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    beyond = places.withColumn("upto", upto).where(F.col("upto") > F.col("left"))
    first = F.min(F.struct("place", (F.col("left") - F.col("upto") + F.col("words")).alias("gap"), "last_shard")).alias("first")
    return beyond.groupBy("nth").agg(first).select("nth", F.col("first.place").alias("cutoff"), F.col("first.gap").alias("gap"), F.col("first.last_shard").alias("last_shard"))


def _fills(left: DataFrame) -> DataFrame:
    """(nth, place) of the documents that close a source's gap; left: (nth, size, place, gap) of those that may."""
    sizes = left.where((F.col("size") > 0) & (F.col("size") <= F.col("gap"))).groupBy("nth", "size").agg(F.min("place").alias("place"), F.first("gap").alias("gap"))
    listed = sizes.groupBy("nth").agg(F.sort_array(F.collect_list(F.struct("size", "place")), asc=False).alias("sizes"), F.first("gap").alias("gap"))  # a row for each size at most
    start = F.struct(F.col("gap").alias("gap"), F.expr("CAST(array() AS ARRAY<BIGINT>)").alias("places"))

    def step(state: Column, x: Column) -> Column:
        fits = (x["size"] <= state["gap"]) & (F.size(state["places"]) < FILLS)
        return F.when(fits, F.struct((state["gap"] - x["size"]).alias("gap"), F.array_append(state["places"], x["place"]).alias("places"))).otherwise(state)

    return listed.select("nth", F.explode(F.aggregate("sizes", start, step, lambda state: state["places"])).alias("place"))


def mix(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", shards: int = SHARDS, payload: bool = False) -> DataFrame:
    """(doc_id, size, source_size, target, copies) of every document; copies: (copy, shard, place) of each that the mix takes.

    A copy's place orders it within its shard. With ``payload`` also ``whole``, a struct of the input's columns, and without size.
    """
    id_, text = docs[id_column].cast("long"), F.coalesce(docs[text_column].cast("string"), F.lit(""))
    place = _digest(F.coalesce(id_.cast("string"), F.lit("none")), F.md5(text.cast("binary")), F.lit("mix"))
    keys = [id_.alias("doc_id"), docs[source_column].cast("string").alias("source"), place.alias("place")]
    block = F.shiftright("place", BITS - _BLOCK_BITS).cast("int")
    narrow = written(docs.select(*keys, word_count(docs[text_column]).alias("size")).withColumn("block", block), "mixing-documents")
    blocks = written(narrow.groupBy("source", "block").agg(F.sum("size").alias("words")), "mixing-blocks")
    sources = written(source_targets(blocks), "mixing-sources")
    few = sources.count() * BLOCKS * MOST <= BROADCAST_ROWS

    def held(small: DataFrame) -> DataFrame:
        return F.broadcast(small) if few else small

    drawn = _drawn(blocks, sources, held, shards)
    cutoffs = written(_cutoffs(narrow, drawn, sources, held), "mixing-cutoffs")
    homes = drawn.groupBy("nth", "block").agg(F.sort_array(F.collect_list(F.struct("copy", "shard", "cut"))).alias("draws"))
    homes = blocks.join(held(sources.withColumnRenamed("source", "_of")), _same_source("_of")).join(held(homes), ["nth", "block"], "left").join(held(cutoffs), "nth", "left")
    homes = written(homes.select(F.col("source").alias("_source"), F.col("block").alias("_block"), "nth", "source_size", "target", "whole", "cutoff", "gap", "last_shard", F.coalesce("draws", F.expr("CAST(array() AS ARRAY<STRUCT<copy: INT, shard: INT, cut: BOOLEAN>>)")).alias("draws")), "mixing-homes")
    at_home = _same_source("_source") & (F.col("block") == F.col("_block"))
    mine = F.filter("draws", lambda x: ~x["cut"] | (F.col("place") < F.col("cutoff")))
    last = F.exists(mine, lambda x: x["copy"] > F.col("whole"))
    left = narrow.join(held(homes.where("gap > 0")), at_home).where(~last).select("nth", "size", "place", "gap")
    fills = written(_fills(left), "mixing-fills").select(F.col("nth").alias("_nth"), F.col("place").alias("_place"), F.lit(True).alias("filled"))  # FILLS for each source at most
    rows = docs.select(*keys, F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("whole_row")).withColumn("block", block) if payload else narrow
    found = rows.join(held(homes), at_home).join(held(fills), (F.col("nth") == F.col("_nth")) & (F.col("place") == F.col("_place")), "left")
    more = F.when(F.col("filled"), F.array(F.struct((F.col("whole") + 1).alias("copy"), F.col("last_shard").alias("shard"), F.lit(False).alias("cut")))).otherwise(F.expr("CAST(array() AS ARRAY<STRUCT<copy: INT, shard: INT, cut: BOOLEAN>>)"))
    copies = F.transform(F.concat(mine, more), lambda x: F.struct(x["copy"].alias("copy"), x["shard"].alias("shard"), _digest(F.col("place"), x["copy"], F.lit("local")).alias("place")))
    return found.select("doc_id", *([F.col("whole_row").alias("whole")] if payload else ["size"]), "source_size", "target", copies.alias("copies"))


def mixed(docs: DataFrame, *, shards: int = SHARDS, **columns: str) -> DataFrame:
    """The mix itself: a row of docs for each copy that is taken, with its shard's documents together and shuffled."""
    copies = mix(docs, shards=shards, payload=True, **columns).select("whole", F.explode("copies").alias("copy"))
    return copies.repartition(F.col("copy.shard"), F.pmod(F.col("copy.place"), F.lit(64))).sortWithinPartitions("copy.shard", "copy.place").select("whole.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix(table(spark, sf_dir, "documents"))
    listed = F.array_join(F.transform("copies", lambda x: F.concat_ws(":", x["shard"].cast("string"), x["place"].cast("string"))), ",")
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("copies")).alias("taken"), listed.alias("copies"))


def _sql_digest(text: str) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, {BITS // 4}) AS BIGINT)"


def _sql_level(k: int) -> str:
    """One level of the tree: sources are drawn one after the other, each conditional on those before it."""
    f = "f[CAST({} AS BIGINT) + 1]".format
    chance = f"exp(fixed - {f('k')} - {f('n - k')} - {f('drawn - k')} - {f('everything - n - drawn + k')})"
    return f"""
level{k}_nodes AS (SELECT first, last, CAST(sum(n) AS BIGINT) AS everything FROM level{k} GROUP BY ALL),
level{k}_drawn AS (
  SELECT first, last, CAST(0 AS BIGINT) AS nth, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS taken, everything,
         CAST(ceil(everything * ((first + last) // 2 - first) / (last - first)) AS BIGINT) AS drawn FROM level{k}_nodes
  UNION ALL
  SELECT first, last, nth, n, taken, everything - n, drawn - taken FROM (
    SELECT *, low + least(len(p) - 1, len(list_filter(list_transform(range(1, len(p) + 1), lambda i: list_sum(p[1:i])), lambda c: c < u))) AS taken FROM (
      SELECT *, list_transform(range(low, high + 1), lambda k: {chance}) AS p FROM (
        SELECT *, CAST(greatest(0, drawn - (everything - n), floor(mean - spread)) AS BIGINT) AS low, CAST(least(n, drawn, ceil(mean + spread)) AS BIGINT) AS high FROM (
          SELECT *, 12 * sqrt(mean * (1 - n / greatest(1, everything)) + 1) + 1 AS spread FROM (
            SELECT d.first, d.last, l.nth, l.n, d.everything, d.drawn, f, d.drawn * (l.n / greatest(1, d.everything)) AS mean,
                   {f('l.n')} + {f('d.everything - l.n')} + {f('d.drawn')} + {f('d.everything - d.drawn')} - {f('d.everything')} AS fixed,
                   {_sql_digest("'tree:' || d.first || ':' || d.last || ':' || l.nth")} / {float(1 << BITS)} AS u
            FROM level{k}_drawn d JOIN level{k} l ON l.first = d.first AND l.last = d.last AND l.nth = d.nth + 1, factorials)))))),
level{k + 1} AS (
  SELECT first, (first + last) // 2 AS last, nth, taken AS n FROM level{k}_drawn WHERE nth > 0
  UNION ALL SELECT (first + last) // 2, last, nth, n - taken FROM level{k}_drawn WHERE nth > 0),"""


#: The query in full: targets, passes, the tree with its hypergeometric draws, cut, fills and shards.
SQL = rf"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         {_sql_digest("coalesce(CAST(doc_id AS VARCHAR), 'none') || ':' || md5(coalesce(text, '')) || ':mix'")} AS place
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS nth FROM sized GROUP BY source),
weighed AS (SELECT *, CAST((nth - 1) % 3 + 1 AS DOUBLE) AS weight, CAST(3 * source_size AS DOUBLE) AS cap FROM sources),
levels AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER before, 0.0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0.0)) AS level
  FROM weighed WINDOW before AS (ORDER BY cap / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, nth, source_size, CASE WHEN cap <= level * weight THEN cap ELSE weight *
           (SELECT level FROM levels WHERE NOT cap <= level * weight ORDER BY cap / weight, nth LIMIT 1) END AS target FROM levels),
goals AS (
  SELECT *, target - whole * source_size AS rest
  FROM (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM targets)),
docs AS (SELECT sized.*, nth, place >> {BITS - _BLOCK_BITS} AS block FROM sized JOIN goals ON sized.source IS NOT DISTINCT FROM goals.source),
blocks AS (SELECT nth, block, sum(size) AS words FROM docs GROUP BY ALL),
passes AS (
  SELECT b.*, whole, rest, copy, {_sql_digest("b.nth || ':' || b.block || ':' || copy || ':draw'")} AS key
  FROM blocks b JOIN goals USING (nth), (SELECT unnest(range(1, {MOST + 2})) AS copy) WHERE copy <= whole + CAST(rest > 0 AS INT)),
ordered AS (
  SELECT *, row_number() OVER w - 1 AS pos, coalesce(sum(words) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         count(*) OVER (PARTITION BY nth, copy) AS n_blocks FROM passes WINDOW w AS (PARTITION BY nth, copy ORDER BY key, block)),
drawn AS (
  SELECT nth, block, copy, (copy - 1) * n_blocks + pos AS draw, rest - before AS room, copy > whole AND before < rest AND before + words > rest AS cut, copy > whole AS partial
  FROM ordered WHERE copy <= whole OR before + words <= rest OR (before < rest AND before + words > rest)),
factorials AS (SELECT list(lgamma(i + 1.0) ORDER BY i) AS f FROM (SELECT unnest(range((SELECT count(*) + 2 FROM drawn))) AS i)),
level0 AS (SELECT 0 AS first, {SHARDS} AS last, nth, (SELECT count(*) FROM drawn WHERE drawn.nth = goals.nth) AS n FROM goals),""" + "".join(_sql_level(k) for k in range(int(math.log2(SHARDS)))) + rf"""
ends AS (SELECT nth, first AS shard, sum(n) OVER (PARTITION BY nth ORDER BY first) AS upto FROM level{int(math.log2(SHARDS))}),
homes AS (SELECT d.*, (SELECT count(*) FROM ends WHERE ends.nth = d.nth AND upto <= draw) AS shard FROM drawn d),
cut AS (SELECT nth, block, copy, room, shard FROM homes WHERE cut),
along AS (
  SELECT nth, place, room, words, sum(words) OVER (PARTITION BY nth ORDER BY place) AS upto
  FROM (SELECT nth, place, room, sum(size) AS words FROM docs JOIN cut USING (nth, block) GROUP BY ALL)),
cutoffs AS (SELECT nth, min(place) AS cutoff, min_by(room - upto + words, place) AS gap FROM along WHERE upto > room GROUP BY nth),
last_pass AS (
  SELECT docs.nth, docs.place FROM docs JOIN homes h ON h.nth = docs.nth AND h.block = docs.block AND h.partial LEFT JOIN cutoffs c ON c.nth = docs.nth WHERE NOT h.cut OR docs.place < cutoff),
open_sizes AS (
  SELECT nth, size, min(place) AS place FROM docs JOIN cutoffs USING (nth)
  WHERE gap > 0 AND size BETWEEN 1 AND gap AND NOT EXISTS (SELECT 1 FROM last_pass l WHERE l.nth = docs.nth AND l.place = docs.place) GROUP BY ALL),
gap0 AS (SELECT nth, gap, CAST(NULL AS BIGINT) AS size FROM cutoffs),""" + "".join(
    f"""
gap{k + 1} AS (
  SELECT nth, gap - coalesce(picked, 0) AS gap, coalesce(picked, 0) AS size
  FROM (SELECT g.nth, g.gap, max(o.size) AS picked FROM gap{k} g LEFT JOIN open_sizes o ON o.nth = g.nth AND o.size <= g.gap AND (g.size IS NULL OR o.size < g.size) GROUP BY g.nth, g.gap)),"""
    for k in range(FILLS)
) + f"""
fills AS (SELECT nth, place FROM ({" UNION ALL ".join(f"SELECT nth, size FROM gap{k + 1}" for k in range(FILLS))}) JOIN open_sizes USING (nth, size)),
copies AS (
  SELECT docs.nth, docs.place, h.copy, h.shard FROM docs JOIN homes h USING (nth, block) LEFT JOIN cutoffs c ON c.nth = docs.nth WHERE NOT h.cut OR docs.place < cutoff
  UNION SELECT nth, place, cut.copy, cut.shard FROM fills JOIN cut USING (nth)),
listed AS (
  SELECT nth, place, count(*) AS n, string_agg(shard || ':' || {_sql_digest("place || ':' || copy || ':local'")}, ',' ORDER BY copy) AS copies FROM copies GROUP BY nth, place)
SELECT doc_id, size, source_size, target, size * coalesce(n, 0) AS taken, coalesce(copies, '') AS copies
FROM docs JOIN goals USING (nth) LEFT JOIN listed USING (nth, place)
"""
