"""Conversations: budgets, routing, filters, listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veinstone.functions import lexicons as L, text as T


def within_budget(turns: DataFrame, budget: int) -> DataFrame:
    """(session, turn, kept, folded) of turns (session, turn, text): the newest turns whose estimated tokens fit; folded: how many did not."""
    newest = Window.partitionBy("session").orderBy(F.desc("turn"))
    spent = turns.withColumn("spent", F.sum(T.token_estimate(F.col("text"))).over(newest))
    kept = spent.withColumn("kept", F.col("spent") <= budget)
    return kept.withColumn("folded", F.count_if(~F.col("kept")).over(Window.partitionBy("session"))).select("session", "turn", "kept", "folded")


def folded_history(turns: DataFrame, budget: int) -> DataFrame:
    """(session, seq, text): a notice with the number of turns left out, if any, then the turns kept."""
    marked = turns.join(within_budget(turns, budget), ["session", "turn"])
    notice = marked.where("folded > 0").groupBy("session").agg(F.max("folded").alias("n")).select("session", F.lit(-1).cast("long").alias("seq"), F.concat(F.lit("[earlier turns left out: "), F.col("n").cast("string"), F.lit("]")).alias("text"))
    return marked.where("kept").select("session", F.col("turn").cast("long").alias("seq"), "text").unionByName(notice)


def last_turns(turns: DataFrame, n: int = 10) -> DataFrame:
    newest = F.row_number().over(Window.partitionBy("session").orderBy(F.desc("turn")))
    return turns.withColumn("_nth", newest).where(F.col("_nth") <= n).drop("_nth")


def listing(turns: DataFrame) -> DataFrame:
    """(session, turns, title, preview): count, and the beginning of the last turn."""
    last = F.max_by("text", "turn")
    return turns.groupBy("session").agg(F.count("*").alias("turns"), F.left(last, F.lit(60)).alias("title"), F.left(last, F.lit(100)).alias("preview"))


def route(messages: DataFrame, deep: str | None = None) -> DataFrame:
    """messages (text) with ``route``: agent, chitchat or rag."""
    agent = T.is_agent_request(F.col("text"))
    if deep:
        agent = agent | F.col(deep)
    return messages.withColumn("route", F.when(agent, "agent").when(T.is_chitchat(F.col("text")), "chitchat").otherwise("rag"))


def for_synthesis(messages: DataFrame) -> DataFrame:
    """Messages (role, tool_calls) without tools' answers and the assistant's calls of tools."""
    calls = (F.col("role").isin("ai", "assistant")) & (F.size(F.coalesce("tool_calls", F.array().cast("array<string>"))) > 0)
    return messages.where((F.col("role") != "tool") & ~calls)


def original_question(messages: DataFrame) -> DataFrame:
    """(session, question): the last message of the user that is no intervention."""
    asked = messages.where(F.col("role").isin("user", "human") & ~F.contains("content", F.lit(L.INTERVENTION)))
    return asked.groupBy("session").agg(F.max_by("content", "seq").alias("question"))


def novelty(outputs: DataFrame, places: int = 6, chars: int = 400, most: float = 0.5, loops: int = 12) -> DataFrame:
    """outputs (task, seq, content) with the overlap of an output's characters and those of the one before, and whether to stop."""
    order = Window.partitionBy("task").orderBy("seq")
    short = F.left("content", F.lit(chars))
    seen = outputs.withColumns({"before": F.lag(short).over(order), "loop": F.row_number().over(order)})
    overlap = F.when(F.col("before").isNotNull(), F.round(T.char_jaccard(short, F.col("before")), places))
    return seen.withColumn("overlap", overlap).withColumn("stop", F.coalesce(F.col("overlap") > most, F.lit(False)) | (F.col("loop") >= loops)).drop("before")


def memory_context(memory: DataFrame, limits: dict[str, int]) -> DataFrame:
    """(context): the memories (scope, content) that are not blank, in the order of ``limits``, each cut to its last characters."""
    texts = [F.max(F.when((F.col("scope") == scope) & T.not_blank(F.col("content")), T.tail(F.col("content"), size, "...")) ) for scope, size in limits.items()]
    return memory.agg(F.concat_ws("\n\n", *texts).alias("context"))


def append_sub_tasks(turns: DataFrame, results: DataFrame) -> DataFrame:
    """turns (session, turn, text) with sub-tasks' results (task, text) added to the last turn of their parent, named like the task without sub_."""
    parents = results.select(F.replace("task", F.lit("sub_"), F.lit("")).alias("session"), F.struct("task", "text").alias("said")).groupBy("session").agg(F.array_join(F.transform(F.sort_array(F.collect_list("said")), lambda x: x["text"]), "\n").alias("more"))
    last = turns.groupBy("session").agg(F.max("turn").alias("last"))
    joined = turns.join(last, "session").join(parents, "session", "left")
    return joined.select("session", "turn", F.when((F.col("turn") == F.col("last")) & F.col("more").isNotNull(), F.concat_ws("\n", "text", "more")).otherwise(F.col("text")).alias("text"))
