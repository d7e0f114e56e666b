"""Queries that run a stream over what is there and give its merged result."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.plans.work import _PIECE
from weftline.streaming import live


def stream_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Calls, errors and calls outstanding of every piece, from the stream of records."""
    return live.run_pieces(live.stream_table(spark, d, "claude"), f"pieces-{uuid.uuid4().hex}").where("n_calls > 0").select("session", "piece", "n_calls", "n_errs", "pending")


def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Events per hour and type, from the stream of events."""
    w = live.run_windows(live.stream_table(spark, d, "events"), f"windows-{uuid.uuid4().hex}")
    return w.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n")


QUERIES = {"stream_pieces": stream_pieces, "stream_windows": stream_windows}
SQL = {
    "stream_pieces": _PIECE + "SELECT session, piece, count(*) AS n_calls, count(*) FILTER (err) AS n_errs, count(*) FILTER (pending) AS pending FROM pc WHERE kind = 'tool' GROUP BY session, piece",
    "stream_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
}
