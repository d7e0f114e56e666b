"""SQLite stores as a Python data source: ``spark.read.format("sqlite_rows")``.

Options: ``path`` (one file, or several joined by ';'), ``query`` (a SELECT whose columns match the schema), ``schema``
through ``.schema(...)``. Each file is one partition, opened read-only; a busy file is tried again with growing waits.
"""

from __future__ import annotations

import sqlite3
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

TRIES = 20


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths = [p for p in options.get("path", "").split(";") if p]
        self.query = options["query"]

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in self.paths]

    def read(self, partition: _File) -> Iterator[tuple]:
        for attempt in range(TRIES):
            try:
                with sqlite3.connect(f"file:{partition.path}?mode=ro", uri=True, timeout=5) as db:
                    rows = db.execute(self.query)
                    while chunk := rows.fetchmany(1000):
                        for row in chunk:
                            yield tuple(x.decode("utf-8", "replace") if isinstance(x, bytes) else x for x in row)
                return
            except sqlite3.OperationalError as e:
                if "locked" not in str(e) or attempt == TRIES - 1:
                    raise
                time.sleep(0.05 * (attempt + 1))


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite_rows"

    def schema(self) -> str:
        return "key string, value string"

    def reader(self, schema) -> SqliteReader:  # noqa: ANN001
        return SqliteReader(self.options)


def rows(spark: SparkSession, path: str, query: str, schema: str) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite_rows").schema(schema).option("path", path).option("query", query).load()


def read_store(spark: SparkSession, path: str, since_ms: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sessions, messages and parts of a message store; only sessions updated since are read, filtered in SQLite."""
    session = rows(spark, path, f"SELECT rowid, id, directory, model, time_created, CAST(time_updated AS TEXT) FROM session WHERE time_updated >= {int(since_ms)}", "row_id bigint, id string, directory string, model string, time_created bigint, time_updated string")
    message = rows(spark, path, f"SELECT m.rowid, m.id, m.session_id, CAST(m.time_created AS TEXT), m.data FROM message m JOIN session s ON s.id = m.session_id WHERE s.time_updated >= {int(since_ms)}", "row_id bigint, id string, session_id string, time_created string, data string")
    part = rows(spark, path, "SELECT rowid, id, message_id, time_created, data FROM part", "row_id bigint, id string, message_id string, time_created bigint, data string")
    return session, message, part


def read_blobs(spark: SparkSession, path: str) -> DataFrame:
    """(row_id, role, text) of a blob store, in order; only blobs that are JSON, of a person's text what the query wrapper holds."""
    b = rows(spark, path, "SELECT rowid, CAST(data AS TEXT) FROM blobs WHERE json_valid(CAST(data AS TEXT)) ORDER BY rowid", "row_id bigint, data string")
    content = F.coalesce(F.get_json_object("data", "$.content"), F.lit(""))
    asked = F.regexp_extract(content, r"(?s)<user_query>\s*(.*?)\s*</user_query>", 1)
    return b.select("row_id", F.get_json_object("data", "$.role").alias("role"), F.when(asked != "", asked).when(F.get_json_object("data", "$.role") != "user", content).alias("text")).where("text is not null")


def read_key_values(spark: SparkSession, path: str) -> DataFrame:
    """(conversation, n, bubble) of a key-value store: the header list of each conversation gives the order of its bubbles."""
    kv = rows(spark, path, "SELECT key, value FROM cursorDiskKV WHERE key LIKE 'composerData:%' OR key LIKE 'bubbleId:%'", "key string, value string")
    head = kv.where(F.col("key").startswith("composerData:")).select(F.substring_index("key", ":", -1).alias("conversation"), F.posexplode(F.from_json(F.get_json_object("value", "$.fullConversationHeadersOnly"), "array<struct<bubbleId: string>>")).alias("n", "h"))
    bubble = kv.where(F.col("key").startswith("bubbleId:")).select(F.split("key", ":")[1].alias("conversation"), F.split("key", ":")[2].alias("bubble_id"), F.col("value").alias("bubble"))
    return head.join(bubble, (head["conversation"] == bubble["conversation"]) & (F.col("h.bubbleId") == F.col("bubble_id"))).select(head["conversation"], "n", "bubble")
