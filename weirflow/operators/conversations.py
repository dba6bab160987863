"""Conversation turns and the audit trail of answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weirflow.functions import ordered


def history(turns: DataFrame, limit: int = 20) -> DataFrame:
    """The last turns of every conversation."""
    return ordered.newest_n(turns, ["conversationId"], [F.col("createdAt").desc(), F.col("turn").desc()], limit)


def list_conversations(turns: DataFrame, limit: int = 25) -> DataFrame:
    """Newest conversations of every user, titled by their first question."""
    asked = turns.filter(F.col("role") == "user")
    rows = asked.groupBy("userId", "conversationId").agg(
        F.substring(F.min_by("content", F.struct("createdAt", "turn")), 1, 80).alias("title"),
        F.max("createdAt").alias("createdAt"),
    )
    return ordered.newest_n(rows, ["userId"], [F.col("createdAt").desc(), F.col("conversationId")], limit)


def transcript(turns: DataFrame, last: int = 6) -> DataFrame:
    """The last turns as "role: text" lines (a bounded list per conversation)."""
    recent = history(turns, last)
    line = F.struct("createdAt", "turn", F.concat_ws(": ", "role", "content").alias("line"))
    listed = recent.groupBy("conversationId").agg(F.sort_array(F.collect_list(line)).alias("_lines"))
    return listed.select("conversationId", F.array_join(F.transform("_lines", lambda x: x["line"]), "\n").alias("transcript"))


def delete(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """Turns without the named conversations."""
    return turns.join(ids.select("conversationId").distinct(), "conversationId", "left_anti")


def deletion_report(turns: DataFrame, ids: DataFrame) -> DataFrame:
    gone = turns.join(ids.select("conversationId").distinct(), "conversationId", "left_semi")
    return gone.groupBy("conversationId").agg(F.count(F.lit(1)).alias("deletedTurns"))


def trace_log(routed: DataFrame, elapsed_ms: str = "elapsedMs", *, citations: DataFrame | None = None, mode: str = "rules") -> DataFrame:
    """One audit row per answered question: who asked, how it was routed, which layers had something to say, and what was cited.

    ``userId`` is taken over where the rows have it. ``citations`` are rows (id, citations) of cited questions. A layer's status is ``ok`` or ``empty``.
    """
    route = F.struct("strategy", "confidence", "specialists", "scores")
    user = F.col("userId") if "userId" in routed.columns else F.lit(None).cast("string")
    found = {
        "devices": F.size("deviceIds") > 0, "sites": F.size("siteIds") > 0, "ontology": F.size("entities") > 0, "routing": F.size("specialists") > 0,
    }
    if citations is not None:
        routed = routed.join(citations.select(F.col("id").alias("questionId"), "citations"), "questionId", "left")
        cited = F.coalesce("citations", F.array().cast("array<string>"))
        found["knowledge"] = F.size(cited) > 0
    else:
        cited = F.array().cast("array<string>")
    status = F.create_map(*[x for layer, there in found.items() for x in (F.lit(layer), F.when(there, "ok").otherwise("empty"))])
    return routed.select(
        F.col("questionId").alias("id"), F.lit("trace").alias("type"), user.alias("userId"), "question", route.alias("route"), status.alias("layerStatus"),
        "deviceIds", "siteIds", "entities", cited.alias("citations"), "pendingApprovals", F.lit(mode).alias("orchestrationMode"), F.col(elapsed_ms).alias("elapsedMs"),
    )


def latency(rows: DataFrame, key: str) -> DataFrame:
    """Turns, percentiles and maximum by ``key``. Percentiles are exact by rank and do not gather a key's rows in one task: rows that are
    alike are counted before, so the window orders one row per millisecond."""
    counts = rows.groupBy(key, "elapsedMs").agg(F.count(F.lit(1)).alias("_n"))
    run = Window.partitionBy(key).orderBy("elapsedMs")
    every = Window.partitionBy(key)
    counts = counts.withColumns({"_upto": F.sum("_n").over(run), "_all": F.sum("_n").over(every)})
    at = {name: F.min(F.when(F.col("_upto") >= F.ceil(F.col("_all") * share), F.col("elapsedMs"))) for name, share in (("p50Ms", 0.5), ("p95Ms", 0.95))}
    return counts.groupBy(key).agg(F.sum("_n").alias("turns"), F.max("elapsedMs").alias("maxMs"), *[x.alias(n) for n, x in at.items()])


def trace_report(traces: DataFrame) -> DataFrame:
    """Answers and latency by strategy, in one pass over the traces."""
    return latency(traces.select(F.col("route.strategy").alias("strategy"), "elapsedMs"), "strategy")


def specialist_report(traces: DataFrame) -> DataFrame:
    """Answers and latency by specialist; an answer counts for each specialist that took part."""
    return latency(traces.select(F.explode("route.specialists").alias("specialist"), "elapsedMs"), "specialist")
