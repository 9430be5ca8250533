"""Segmentation of text that has no spaces, by a dictionary.

A run of CJK characters has a lattice: each of its substrings that the dictionary holds, and each character alone, is an edge with the logarithm of its
frequency over the total (1 for a character that isn't there). The words are the path with the greatest sum, found by a dynamic program from left to
right; of equal paths the one whose last word is longest, then the one before that. Logarithms count in whole millionths, so sums are exact.

Everything is joins and array functions, once for each distinct run: the dictionary may have any size, and is broadcast only if it is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veinstone.functions import text as T
from veinstone.operators.search import held
from veinstone.operators.tables import settled

RUNS = r"[0-9a-zß-öø-ɏ]+|[一-鿿]+"
CJK = "^[一-鿿]"


def _lattice(runs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(run, ends, known): for each end in order, the edges (start, weight) that lead to it; and the run's words of two and three characters."""
    words = settled(dictionary.where("frequency > 0 AND length(word) > 0").groupBy("word").agg(F.sum("frequency").alias("frequency")), "dictionary")
    size = words.agg(F.coalesce(F.sum("frequency"), F.lit(1)).alias("total"), F.coalesce(F.max(F.length("word")), F.lit(1)).alias("longest")).first()
    start = runs.select("run", F.explode(F.sequence(F.lit(0), F.length("run") - 1)).alias("start"))
    piece = start.select("run", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(size["longest"]), F.length("run") - F.col("start")))).alias("size"))
    piece = piece.withColumn("word", F.substr("run", F.col("start") + 1, F.col("size")))
    edge = piece.join(held(words), "word", "left").where("frequency IS NOT NULL OR size = 1")
    weight = F.round(1_000_000 * F.log(F.coalesce("frequency", F.lit(1)) / F.lit(size["total"]))).cast("long")
    known = F.collect_set(F.when(F.col("frequency").isNotNull() & F.col("size").between(2, 3), F.col("word")))
    at = edge.groupBy("run", (F.col("start") + F.col("size")).alias("end")).agg(F.collect_list(F.struct("start", weight.alias("weight"))).alias("edges"), known.alias("known"))  # as many as the longest word has characters
    return at.groupBy("run").agg(F.sort_array(F.collect_list(F.struct("end", "edges"))).alias("ends"), F.array_distinct(F.flatten(F.collect_list("known"))).alias("known"))


def _best(run: Column, ends: Column) -> Column:
    """The words of the best path."""
    begun = F.struct(F.array(F.lit(0).cast("long")).alias("sums"), F.array(F.lit(0)).alias("starts"))

    def step(state: Column, at: Column) -> Column:
        best = F.array_max(F.transform(at["edges"], lambda e: F.struct((F.get(state["sums"], e["start"]) + e["weight"]).alias("sum"), (-e["start"]).alias("back"))))
        return F.struct(F.array_append(state["sums"], best["sum"]).alias("sums"), F.array_append(state["starts"], (-best["back"]).cast("int")).alias("starts"))

    starts = F.aggregate(ends, begun, step, lambda state: state["starts"])
    last = F.struct(F.size(ends).alias("at"), F.array().cast("array<string>").alias("words"), starts.alias("starts"))

    def back(state: Column, _: Column) -> Column:
        start = F.get(state["starts"], state["at"])
        word = F.substr(run, start + 1, state["at"] - start)
        return F.struct(F.greatest(start, F.lit(0)).alias("at"), F.when(state["at"] > 0, F.array_append(state["words"], word)).otherwise(state["words"]).alias("words"), state["starts"].alias("starts"))

    return F.reverse(F.aggregate(ends, last, back, lambda state: state["words"]))


def cut(runs: DataFrame, dictionary: DataFrame, for_search: bool = False) -> DataFrame:
    """(run, words) of distinct runs (run); dictionary: (word, frequency). for_search: before a longer word, the words of two and then of three characters in it."""
    found = _lattice(runs, dictionary).select("run", _best(F.col("run"), F.col("ends")).alias("words"), "known")
    if not for_search:
        return found.drop("known")

    def parts(word: Column, n: int) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.greatest(F.length(word) - n + 1, F.lit(1))), lambda k: F.substr(word, k, F.lit(n)))
        return F.when(F.length(word) > n, F.filter(every, lambda p: F.array_contains("known", p))).otherwise(F.array().cast("array<string>"))

    return found.select("run", F.flatten(F.transform("words", lambda w: F.concat(parts(w, 2), parts(w, 3), F.array(w)))).alias("words"))


def tokens(texts: DataFrame, dictionary: DataFrame, for_search: bool = True) -> DataFrame:
    """(id, words) of texts (id, text), one row for each id: Latin and number runs as they are, others by the dictionary, in the order of the text. Null and empty texts have none."""
    clean = F.lower(T.half_width(F.coalesce("text", F.lit(""))))
    runs = settled(texts.select("id", F.posexplode_outer(F.regexp_extract_all(clean, F.lit(RUNS), F.lit(0))).alias("nth", "run")), "runs")
    found = cut(runs.where(F.col("run").rlike(CJK)).select("run").distinct(), dictionary, for_search)
    joined = runs.join(found, "run", "left").withColumn("words", F.when(F.col("run").isNull(), F.array().cast("array<string>")).otherwise(F.coalesce("words", F.array("run"))))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("nth", "words"))), lambda x: x["words"])  # of one text
    return joined.groupBy("id").agg(F.flatten(listed).alias("words"))
