"""Live capture: pieces of work from a stream of log records, with results that come late.

Per session the state holds counters of each piece and the calls that wait for their result, never the events. An ask
closes the open piece; a result that comes later changes the piece that made the call and sends it out again. Rows go
to an upsert log as provisional (the open piece, or calls outstanding) or final; the log's merge rule settles them.
"""

from __future__ import annotations

import os
import pickle
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weftline.operators.events import CONTINUE
from weftline.operators.stage import shared_path
from weftline.sources.sinks import merged, upsert_log

PIECE = "session string, piece bigint, n_calls bigint, n_errs bigint, pending bigint, source_ms bigint, lane string"
_CONTINUE = re.compile(CONTINUE)


def stream_table(spark: SparkSession, d: str, name: str, files: int = 1000) -> DataFrame:
    """The table ``name`` of a directory as a stream, a file or a folder of part files; the schema is the table's own."""
    path = f"{d}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files)
    if os.path.isdir(path):
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(d)


def live_blocks(records: DataFrame) -> DataFrame:
    """The blocks of streamed records that matter: asks, calls and results."""
    main = records.where("sessionId is not null and message is not null and not coalesce(isSidechain, false)")
    b = main.select("uuid", F.col("sessionId").alias("session"), "row_id", F.unix_millis(F.col("ingested_at").cast("timestamp")).alias("ms"), F.col("message.role").alias("role"), F.posexplode("message.content").alias("pos", "b"))
    kind = F.when((F.col("b.type") == "text") & (F.col("role") == "user") & (F.trim("b.text") != ""), "ask").when(F.col("b.type") == "tool_use", "tool").when(F.col("b.type") == "tool_result", "result")
    return b.withColumn("kind", kind).where("kind is not null").select("session", "uuid", "row_id", "pos", "ms", "kind", F.when(F.col("kind") == "ask", F.col("b.text")).alias("text"), F.coalesce("b.id", "b.tool_use_id").alias("call_id"), F.coalesce("b.is_error", F.lit(False)).alias("err"))


class LivePieces:
    """The state of one session; batch and stream feed the same class."""

    def __init__(self) -> None:
        self.piece = 0
        self.rows: dict[int, list[int]] = {}  # piece: calls, errors, pending, ms
        self.waiting: dict[str, int] = {}
        self.early: dict[str, bool] = {}
        self.seen: set[str] = set()

    def feed(self, pdf: pd.DataFrame) -> set[int]:
        """Takes new blocks in order; gives the pieces that changed. A doubled record counts once."""
        dirty: set[int] = set()
        for uuid, pos, ms, kind, text, call, err in pdf.sort_values(["row_id", "pos"])[["uuid", "pos", "ms", "kind", "text", "call_id", "err"]].itertuples(index=False):
            mark = f"{uuid}/{pos}"
            if mark in self.seen:
                continue
            self.seen.add(mark)
            if kind == "ask":
                if not _CONTINUE.search(text):
                    dirty.add(self.piece)
                    self.piece += 1
                at = self.piece
            elif kind == "tool":
                at = self.piece
                row = self.rows.setdefault(at, [0, 0, 0, 0])
                row[0] += 1
                if call in self.early:
                    row[1] += self.early.pop(call)
                elif call is not None:
                    row[2] += 1
                    self.waiting[call] = at
            else:
                at = self.waiting.pop(call, None)
                if at is None:
                    if call is not None:
                        self.early.setdefault(call, bool(err))
                    continue
                self.rows[at][1] += bool(err)
                self.rows[at][2] -= 1
            row = self.rows.setdefault(at, [0, 0, 0, 0])
            row[3] = max(row[3], int(ms))
            dirty.add(at)
        return dirty

    def out(self, session: str, dirty: set[int]) -> pd.DataFrame:
        rows = [(session, p, *self.rows[p][:3], self.rows[p][3], "final" if p < self.piece and not self.rows[p][2] else "provisional") for p in sorted(dirty) if p in self.rows]
        return pd.DataFrame(rows, columns=[c.strip().split(" ")[0] for c in PIECE.split(",")])


def _update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    live = pickle.loads(state.get[0]) if state.exists else LivePieces()
    parts = list(batches)  # what one trigger brings of one session
    dirty = live.feed(pd.concat(parts, ignore_index=True)) if parts else set()
    state.update((pickle.dumps(live),))
    yield live.out(key[0], dirty)


def run_pieces(records: DataFrame, name: str) -> DataFrame:
    """Runs the stream over what is there and gives the merged table of pieces."""
    spark = records.sparkSession
    at, log = shared_path(spark, f"{name}-at"), shared_path(spark, f"{name}-log")
    stream = live_blocks(records).groupBy("session").applyInPandasWithState(_update, PIECE, "blob binary", "update", GroupStateTimeout.NoTimeout)
    q = stream.writeStream.outputMode("update").option("checkpointLocation", at).foreachBatch(lambda df, n: upsert_log(df, n, log)).trigger(availableNow=True).start()
    q.awaitTermination()
    return merged(spark, log, ["session", "piece"])


def settle(table: DataFrame, now_ms: int, quiet_ms: int = 1_800_000) -> DataFrame:
    """Provisional rows become final when nothing is pending and nothing changed for ``quiet_ms``."""
    quiet = (F.col("pending") == 0) & (F.col("source_ms") <= now_ms - quiet_ms)
    return table.withColumn("lane", F.when(quiet, "final").otherwise(F.col("lane")))


def since(records: DataFrame, activated_ms: int) -> DataFrame:
    """Capture boundary: blocks of sessions whose first record is not older than the activation; earlier sessions stay out whole."""
    first = records.groupBy("session").agg(F.min("ms").alias("first_ms"))
    return records.join(first.where(F.col("first_ms") >= activated_ms).select("session"), "session", "left_semi")


def live_session(files: DataFrame, now_ms: int, hours: int = 6) -> DataFrame:
    """The file that was written last within ``hours``, as a view over (file, modified_ms, size); at a tie the larger name."""
    return files.where(F.col("modified_ms") > now_ms - hours * 3_600_000).agg(F.max(F.struct("modified_ms", "file")).alias("m")).where("m is not null").select("m.file", "m.modified_ms")


def rebased(pieces: DataFrame) -> DataFrame:
    """Pieces numbered from each session's first kept piece: positions in the state are absolute, what is shown begins at 1."""
    first = pieces.groupBy("session").agg(F.min("piece").alias("base"))
    return pieces.join(first, "session").withColumn("piece", F.col("piece") - F.col("base") + 1).drop("base")


def run_windows(events: DataFrame, name: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts per tumbling window and type of a stream (ts, event_type, value), with a watermark; the merged result."""
    spark = events.sparkSession
    at, log = shared_path(spark, f"{name}-at"), shared_path(spark, f"{name}-log")
    w = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    rows = w.select(F.col("w.start").alias("start"), "event_type", "n", "total", F.lit("provisional").alias("lane"), F.col("n").alias("source_ms"))
    q = rows.writeStream.outputMode("update").option("checkpointLocation", at).foreachBatch(lambda df, n: upsert_log(df, n, log)).trigger(availableNow=True).start()
    q.awaitTermination()
    return merged(spark, log, ["start", "event_type"]).drop("lane", "source_ms")
