"""Retrieval quality and run summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veinstone.functions import lexicons as L


def keyword_recall(results: DataFrame) -> DataFrame:
    """(query_id, recall, mrr) of results (query_id, rank, text, expected array): keywords found in all texts together, and 1 / rank of the first text with any.

    Results are a query's few best rows, so its texts come together.
    """
    has = lambda text: F.filter("expected", lambda k: F.contains(F.lower(text), F.lower(k)))
    found = results.withColumn("hit", has(F.col("text"))).groupBy("query_id").agg(
        F.first("expected").alias("expected"), F.array_distinct(F.flatten(F.collect_list("hit"))).alias("hit"), F.min(F.when(F.size("hit") > 0, F.col("rank"))).alias("first")
    )
    recall = F.when(F.size("expected") > 0, F.size("hit") / F.size("expected")).otherwise(0.0)
    return found.select("query_id", recall.alias("recall"), F.coalesce(1.0 / (F.col("first") + 1), F.lit(0.0)).alias("mrr"))


def ranking_quality(ranked: DataFrame, relevant: DataFrame, k: int, places: int = 6) -> DataFrame:
    """(query_id, recall, mrr) at k of ranked (query_id, id, rank) against relevant (query_id, id)."""
    totals = relevant.groupBy("query_id").agg(F.count("*").alias("relevant"))
    hits = ranked.where(F.col("rank") < k).join(relevant, ["query_id", "id"]).groupBy("query_id").agg(F.count("*").alias("hits"), F.min("rank").alias("first"))
    joined = totals.join(hits, "query_id", "left")
    return joined.select("query_id", F.round(F.coalesce("hits", F.lit(0)) / F.col("relevant"), places).alias("recall"), F.round(F.coalesce(1.0 / (F.col("first") + 1), F.lit(0.0)), places).alias("mrr"))


def keyword_coverage(text: Column, expected: Column) -> Column:
    """struct<coverage, found, missing>: expected keywords in the text, in their order."""
    found = F.filter(expected, lambda k: F.contains(F.lower(text), F.lower(k)))
    missing = F.filter(expected, lambda k: ~F.contains(F.lower(text), F.lower(k)))
    return F.struct(F.when(F.size(expected) > 0, F.round(F.size(found) / F.size(expected), 2)).otherwise(0.0).alias("coverage"), found.alias("found"), missing.alias("missing"))


def verdict(answers: DataFrame) -> DataFrame:
    """answers with reasons, warnings and passed; they carry error, coverage, quality, has_source, needs_source, text and figures.

    figures: a pattern of what must be mentioned, or null. Missing sources are a warning only for answers of quality 4 or more; an
    answer with an error is not looked at further.
    """
    reason = lambda when, name: F.when(F.coalesce(when, F.lit(False)), F.lit(name))
    there = F.col("error").isNull()
    no_source = there & F.col("needs_source") & ~F.col("has_source")
    no_figure = there & F.col("figures").isNotNull() & ~F.regexp_like("text", F.concat(F.lit("(?i)"), "figures"))
    reasons = F.array_compact(F.array(
        reason(~there, "error"), reason(there & (F.col("quality") < 2), "quality"), reason(there & (F.col("coverage") < 0.5), "coverage"),
        reason(no_source & (F.coalesce("quality", F.lit(0)) < 4), "source"), reason(no_figure, "figure"),
    ))
    return answers.withColumn("reasons", reasons).withColumns({"passed": F.size("reasons") == 0, "warned": F.coalesce(no_source & (F.col("quality") >= 4), F.lit(False))})


def most_loops(logs: DataFrame, pattern: str, by: list[str]) -> DataFrame:
    """(by, loops): the largest number that a pattern's group names in the logs (text) of each run, 0 for none."""
    each = F.array_max(F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)), lambda n: n.cast("int")))
    return logs.groupBy(*by).agg(F.coalesce(F.max(each), F.lit(0)).alias("loops"))


def summary(runs: DataFrame) -> DataFrame:
    """(passed, failed, seconds, quality, calls) of runs (passed, seconds, quality, calls); a quality of 0 is none."""
    return runs.agg(
        F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"), F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("seconds"),
        F.coalesce(F.avg(F.nullif("quality", F.lit(0))), F.lit(0.0)).alias("quality"), F.coalesce(F.sum("calls"), F.lit(0)).alias("calls"),
    )


def by_mode(runs: DataFrame) -> DataFrame:
    """(mode, recall, mrr, seconds): means of each retrieval mode."""
    return runs.groupBy("mode").agg(*(F.avg(c).alias(c) for c in ("recall", "mrr", "seconds")))


def tool_calls(logs: DataFrame, pattern: str) -> DataFrame:
    """(tool, calls): how often a pattern's group names each tool in the logs (text)."""
    return logs.select(F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("tool")).groupBy("tool").agg(F.count("*").alias("calls"))


def cites(text: Column) -> Column:
    return F.coalesce(text.rlike(L.CITATION), F.lit(False))


def sources(results: DataFrame) -> DataFrame:
    """(doc_id, filename, score, kind, pages) of results (rank, doc_id, filename, score, kind, page): the first of each document, its pages in order of rank."""
    first = lambda c: F.min_by(c, "rank").alias(c)
    pages = F.sort_array(F.collect_list(F.when(F.col("page") > 0, F.struct("rank", "page"))))
    return results.groupBy("doc_id").agg(first("filename"), first("score"), first("kind"), F.array_distinct(F.transform(pages, lambda x: x["page"])).alias("pages"))
