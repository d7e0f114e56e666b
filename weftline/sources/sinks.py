"""Sinks: partitioned tables without secrets, append that skips what is there, upsert by key, snapshots, exports, and uploads with a ledger."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weftline.operators.secrets import redact_rows
from weftline.operators.stage import written
from weftline.streaming.tail import Backoff


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def write_table(df: DataFrame, path: str, by: list[str] | None = None, redact: bool = True) -> None:
    """A parquet table, overwritten, partitioned by columns of few values; secrets are replaced in every string unless ``redact`` is off."""
    w = (redact_rows(df) if redact else df).write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)


def append_new(df: DataFrame, path: str, key: str) -> int:
    """Appends the rows whose key the table does not hold yet, each key once; gives how many."""
    spark = df.sparkSession
    new = df.dropDuplicates([key])
    if exists(spark, path):
        new = new.join(spark.read.parquet(path).select(key), key, "left_anti")
    new = new.persist()
    n = new.count()
    if n:
        new.write.mode("append").parquet(path)
    new.unpersist()
    return n


def newest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the last by ``order``."""
    w = W.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def upsert_log(df: DataFrame, batch: int, path: str) -> None:
    """Writes one batch of an upsert log; a batch that is repeated overwrites itself, so a retry changes nothing."""
    df.withColumn("_batch", F.lit(batch)).write.mode("overwrite").parquet(f"{path}/batch={batch}")


def merged(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The table that an upsert log amounts to. A final row beats a provisional one of the same time; an older time never wins."""
    log = spark.read.option("basePath", path).parquet(f"{path}/batch=*").drop("batch")
    return newest(log.withColumn("_final", (F.col("lane") == "final").cast("int")), keys, ["source_ms", "_final", "_batch"]).drop("_batch", "_final")


def snapshot(df: DataFrame, path: str) -> str:
    """Writes ``df`` as a new version and then makes it the current one by its name in a small file; readers of the old version are not disturbed, and a failed write leaves the old one current. Gives the version's path."""
    spark = df.sparkSession
    version = f"{path}/v-{uuid.uuid4().hex}"
    df.write.parquet(version)
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").json(f"{path}/current")
    return version


def current(spark: SparkSession, path: str) -> DataFrame:
    """The current version of a snapshot."""
    return spark.read.parquet(spark.read.schema("version string").json(f"{path}/current").first()[0])


def export_json(df: DataFrame, path: str, newest_by: str, limit: int = 1000) -> None:
    """The newest rows as JSON lines, without secrets; the limit is the feature."""
    redact_rows(df.orderBy(F.desc(newest_by)).limit(limit)).write.mode("overwrite").json(path)


class Limited(Exception):
    """The other side asks to wait ``seconds``."""

    def __init__(self, seconds: float):
        super().__init__(f"wait {seconds} s")
        self.seconds = seconds


class Refused(Exception):
    """The other side will never take this batch."""


def send_batch(rows: list[dict], send: Callable[[list[dict]], None], wait: Callable[[float], None] = time.sleep, attempts: int = 4) -> list[dict]:
    """Sends a batch and gives the rows that were taken. A batch that is refused goes again row by row, so one bad row
    costs itself only; failures are tried again after a growing wait, and a time to wait that the receiver names is kept."""
    backoff = Backoff()
    for _ in range(attempts):
        try:
            send(rows)
            return rows
        except Refused:
            return [] if len(rows) == 1 else [r for x in rows for r in send_batch([x], send, wait, attempts)]
        except Limited as e:
            pause = backoff.after_limit(e.seconds)
        except OSError:
            pause = backoff.after_failure()
        if pause is None:
            return []
        wait(pause)
    return []


def upload(df: DataFrame, ledger: str, key: str, send: Callable[[list[dict]], None], batch: int = 25, known: Callable[[list[tuple]], list[tuple]] | None = None) -> int:
    """Sends rows whose fingerprint the ledger does not hold, in batches, from the executors' partitions; gives how many were taken.

    The version of a row is its key with the fingerprint of its content. What is to be sent is written as pending
    before, and what was taken as sent after; pending rows of an earlier run are asked for with ``known`` (keys and
    fingerprints; gives those that arrived) and sent again only where they did not.
    """
    spark = df.sparkSession
    cols = [c for c in df.columns if c != key]
    mark = df.withColumn("fingerprint", F.sha2(F.to_json(F.struct(*cols)), 256))
    if exists(spark, ledger):
        mark = mark.join(spark.read.parquet(ledger).where("state = 'sent'").select(key, "fingerprint"), [key, "fingerprint"], "left_anti")
    staged = written(mark)  # what is sent is fixed before: a lost executor sends the same rows again, under the same key
    staged.select(key, "fingerprint", F.lit("pending").alias("state")).write.mode("append").parquet(ledger)

    def push(rows):  # noqa: ANN001, ANN202
        held: list[dict] = []

        def flush() -> list[tuple]:
            there = set(known([(r[key], r["fingerprint"]) for r in held])) if known else set()
            rest = [r for r in held if (r[key], r["fingerprint"]) not in there]
            taken = send_batch(rest, send) if rest else []
            return [*there, *((r[key], r["fingerprint"]) for r in taken)]

        for r in rows:
            held.append(r.asDict())
            if len(held) == batch:
                yield from flush()
                held = []
        if held:
            yield from flush()

    kind = df.schema[key].dataType.simpleString()
    done = written(spark.createDataFrame(staged.rdd.mapPartitions(push), f"{key} {kind}, fingerprint string"))
    done.withColumn("state", F.lit("sent")).write.mode("append").parquet(ledger)
    return done.count()
