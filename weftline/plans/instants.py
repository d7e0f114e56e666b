"""Queries of problem 6: mixed timestamp formats and time zones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.instants import to_instants, usual_epoch, usual_iso
from weftline.operators.stage import salted_left_join
from weftline.sources.tables import table


def session_machines(sessions: DataFrame) -> DataFrame:
    """One machine per session of the store: the largest name of its snapshots, which do not differ in clean data."""
    return sessions.where(F.col("id").isNotNull()).groupBy(F.col("id").alias("session_id")).agg(F.max("machine").alias("machine"))


def time_texts(spark: SparkSession, d: str) -> DataFrame:
    """All time texts with the machine whose clock wrote them: (src_table, row_id, text, machine)."""
    claude = table(spark, d, "claude").select(F.lit("claude").alias("src_table"), "row_id", F.col("timestamp").alias("text"), "machine")
    sessions = table(spark, d, "oc_session")
    message = salted_left_join(table(spark, d, "oc_message").select("row_id", F.col("time_created").alias("text"), "session_id"), session_machines(sessions), ["session_id"])
    message = message.select(F.lit("oc_message").alias("src_table"), "row_id", "text", "machine")
    session = sessions.select(F.lit("oc_session").alias("src_table"), "row_id", F.col("time_updated").alias("text"), "machine")
    return claude.unionByName(message).unionByName(session)


def unusual(df: DataFrame) -> DataFrame:
    usual = F.when(F.col("src_table") == "claude", usual_iso(F.col("text"))).otherwise(usual_epoch(F.col("text")))
    return df.where(F.col("text").isNotNull() & ~usual)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    found = to_instants(unusual(time_texts(spark, d)), "text", table(spark, d, "machines"))
    return found.where(F.col("utc_ms").isNotNull()).select("src_table", "row_id", "utc_ms")


def p6_instants(spark: SparkSession, d: str) -> DataFrame:
    """One UTC instant per row of the three tables, null where the text states none."""
    return to_instants(time_texts(spark, d), "text", table(spark, d, "machines")).select("src_table", "row_id", "utc_ms")


QUERIES = {"p6_found": p6_found, "p6_instants": p6_instants}
