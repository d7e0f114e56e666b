"""Discovery of transcript files and readers for their formats.

All readers give lines or documents as DataFrames; normalisation is done by ``weftline.operators.events``. Schemas are
declared, never inferred. A folder of files is listed by Spark, so a listing of any size is a DataFrame.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

_BLOCK = "type string, text string, thinking string, id string, name string, input string, tool_use_id string, content string, is_error boolean"
CHAT = (
    "uuid string, parentUuid string, type string, timestamp string, cwd string, sessionId string, isSidechain boolean, permissionMode string, machine string, "
    "message struct<role: string, model: string, id: string, usage: struct<input_tokens: int, cache_creation_input_tokens: int, cache_read_input_tokens: int, output_tokens: int>, content: string>"
)


def discover(spark: SparkSession, folder: str, pattern: str = "*", since: str | None = None, skip: str = r"/(subagents|tool-results)/") -> DataFrame:
    """(file, size, modified) of the files under a folder; contents are not read. ``since`` is a time as Spark's readers take it."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    if since:
        reader = reader.option("modifiedAfter", since)
    files = reader.load(folder).select(F.col("path").alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return files.where(~F.col("file").rlike(skip))


def prefer(files: DataFrame, first: str = "jsonl") -> DataFrame:
    """Of files that differ in their extension only, the one with the extension ``first``, or else the least."""
    stem = F.regexp_replace("file", r"\.[^./]+$", "")
    w = W.partitionBy("stem").orderBy((F.regexp_extract("file", r"\.([^./]+)$", 1) != first).cast("int"), "file")
    return files.withColumn("stem", stem).withColumn("k", F.row_number().over(w)).where("k = 1").drop("stem", "k")


def changed(files: DataFrame, seen: DataFrame) -> DataFrame:
    """Files that are new or whose size or time differ from those in ``seen``: what an incremental scan reads again."""
    return files.join(seen.select("file", "size", "modified"), ["file", "size", "modified"], "left_anti")


def archived_only(archive: DataFrame, live: DataFrame) -> DataFrame:
    """Archive copies whose original is gone, by name without ``.gz``."""
    name = lambda: F.regexp_replace(F.substring_index("file", "/", -1), r"\.gz$", "")
    return archive.withColumn("name", name()).join(live.select(name().alias("name")), "name", "left_anti").drop("name")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, raw) of text files; gz files are read as they are. Line numbers are those of one file's rows in order."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("k"), F.col("value").alias("raw"))
    return raw.select("file", F.row_number().over(W.partitionBy("file").orderBy("at", "k")).alias("line_no"), "raw")


def _chat_rows(raw: DataFrame) -> DataFrame:
    """The table of a chat log from its lines; content given as a plain string is one text block, results keep arrays as JSON text."""
    r = raw.where(F.length("raw") >= 20).select("file", "line_no", F.from_json("raw", CHAT).alias("r")).where("r is not null")
    c = F.col("r.message.content")
    kinds = [x.split(" ") for x in _BLOCK.split(", ")]
    as_text = F.array(F.struct(*[(F.lit("text") if n == "type" else c if n == "text" else F.lit(None).cast(t)).alias(n) for n, t in kinds]))
    as_blocks = F.from_json(c, "array<struct<" + ", ".join(f"{n}: {t}" for n, t in kinds) + ">>")
    blocks = F.when(c.rlike(r"^\s*\["), as_blocks).when(c.isNotNull(), as_text)
    m = F.struct(*[F.col(f"r.message.{k}").alias(k) for k in ("role", "model", "id", "usage")], blocks.alias("content"))
    top = [F.col(f"r.{k}").alias(k) for k in ("uuid", "parentUuid", "type", "timestamp", "cwd", "sessionId", "isSidechain", "permissionMode", "machine")]
    uuid = F.coalesce("uuid", F.concat_ws("#", "file", F.col("row_id").cast("string")))
    df = r.select("file", F.col("line_no").cast("bigint").alias("row_id"), *top, m.alias("message"))
    return df.withColumn("uuid", uuid).withColumn("ingested_at", F.try_to_timestamp("timestamp"))


def read_chat(spark: SparkSession, path: str) -> DataFrame:
    """JSONL chat logs with the columns of the table ``claude``."""
    return _chat_rows(lines(spark, path))


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """JSONL sessions that open with a start record: its id, folder and time go to the messages of the file."""
    raw = lines(spark, path)
    start = raw.where(F.get_json_object("raw", "$.type") == "session_start").groupBy("file").agg(F.min(F.get_json_object("raw", "$.id")).alias("sid"), F.min(F.get_json_object("raw", "$.cwd")).alias("dir"))
    rows = _chat_rows(raw.where(F.get_json_object("raw", "$.type") == "message"))
    return rows.join(start, "file", "left").withColumn("sessionId", F.coalesce("sessionId", "sid", "file")).withColumn("cwd", F.coalesce("cwd", "dir")).drop("sid", "dir")


def read_rollouts(spark: SparkSession, path: str) -> DataFrame:
    """JSONL rollouts with the columns of the table ``codex``; nested output and items stay JSON text."""
    schema = "timestamp string, type string, payload struct<type: string, role: string, name: string, call_id: string, cwd: string, id: string, content: array<struct<type: string, text: string>>, input: string, arguments: string, output: string, item: string>"
    r = lines(spark, path).select("file", "line_no", F.from_json("raw", schema).alias("r")).where("r.type is not null")
    return r.select(F.xxhash64("file", "line_no").alias("row_id"), F.col("file").alias("file_name"), "line_no", "r.timestamp", "r.type", "r.payload")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """JSON documents of one session each, as events: (session, i, kind, ts, text, tool, target, err, input, output tokens)."""
    schema = "sessionId string, startTime string, messages array<struct<id: string, timestamp: string, type: string, model: string, content: string, thoughts: array<struct<subject: string, description: string>>, toolCalls: array<struct<name: string, status: string, args: string, result: string>>, tokens: struct<input: bigint, output: bigint, cached: bigint, thoughts: bigint>>>"
    d = spark.read.schema(schema).option("multiLine", True).json(path).select("sessionId", F.posexplode("messages").alias("m_no", "m"))
    said = d.where("trim(m.content) <> ''").select("sessionId", "m_no", F.lit(-1).alias("t_no"), F.when(F.col("m.type") == "user", "ask").otherwise("say").alias("kind"), "m.timestamp", F.col("m.content").alias("text"), *[F.lit(None).cast(t).alias(c) for c, t in (("tool", "string"), ("target", "string"), ("err", "boolean"))], "m.tokens")
    called = d.select("sessionId", "m_no", "m", F.posexplode("m.toolCalls").alias("t_no", "t")).select("sessionId", "m_no", "t_no", F.lit("tool").alias("kind"), "m.timestamp", F.lit(None).cast("string").alias("text"), F.col("t.name").alias("tool"), F.coalesce(*[F.get_json_object("t.args", f"$.{k}") for k in ("file_path", "command", "pattern", "path")]).alias("target"), (F.col("t.status") == "error").alias("err"), F.lit(None).cast("struct<input: bigint, output: bigint, cached: bigint, thoughts: bigint>").alias("tokens"))
    w = W.partitionBy("sessionId").orderBy("m_no", "t_no")
    ev = said.unionByName(called).withColumn("i", F.row_number().over(w) - 1)
    return ev.select(F.col("sessionId").alias("session"), "i", "kind", F.try_to_timestamp("timestamp").alias("ts"), "text", "tool", "target", "err", F.col("tokens.input").alias("input"), (F.col("tokens.output") + F.coalesce("tokens.thoughts", F.lit(0))).alias("output"), F.col("tokens.cached").alias("cached"))


def _apply(doc: object, op: dict) -> object:
    """One entry of an event-sourced document: 0 replaces it, 1 sets a path, 2 appends to the list at a path, cut to ``i`` before."""
    if op.get("kind") == 0:
        return op.get("v")
    keys = op.get("k") or []
    at = doc
    for a, b in zip(keys[:-1], keys[1:]):
        nxt = at[int(a)] if isinstance(at, list) else at.get(a)
        if nxt is None:
            nxt = [] if str(b).isdigit() else {}
            at[a] = nxt
        at = nxt
    last = keys[-1]
    if op.get("kind") == 1:
        if isinstance(at, list):
            at[int(last)] = op.get("v")
        else:
            at[last] = op.get("v")
    else:
        have = (at[int(last)] if isinstance(at, list) else at.setdefault(last, [])) or []
        if op.get("i") is not None:
            del have[op["i"] :]
        have.extend(op.get("v") or [])
        at[int(last) if isinstance(at, list) else last] = have
    return doc


def replay(raw: DataFrame) -> DataFrame:
    """(file, document) of event-sourced JSONL lines (file, line_no, raw): a fold over the entries of a file in order.

    Entries that are no JSON or address a path that is not there are passed over. A partition is read as a stream sorted
    by file and line; one document is held at a time.
    """

    def kernel(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        file, doc = None, None
        for pdf in batches:
            done = []
            for name, text in zip(pdf["file"].array, pdf["raw"].array):
                if name != file:
                    if file is not None:
                        done.append((file, json.dumps(doc, ensure_ascii=False)))
                    file, doc = name, None
                try:
                    doc = _apply(doc, json.loads(text))
                except (ValueError, TypeError, KeyError, IndexError, AttributeError):
                    continue
            yield pd.DataFrame(done, columns=["file", "document"])
        if file is not None:
            yield pd.DataFrame([(file, json.dumps(doc, ensure_ascii=False))], columns=["file", "document"])

    n = int(raw.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return raw.repartition(n, "file").sortWithinPartitions("file", "line_no").select("file", "raw").mapInPandas(kernel, "file string, document string")


READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"claude": read_chat, "droid": read_sessions, "codex": read_rollouts, "gemini": read_documents, "copilot": lambda s, p: replay(lines(s, p))}


def read(spark: SparkSession, path: str, client: str) -> DataFrame:
    """Reads by client; an unknown client is read as a chat log."""
    return READERS.get(client, read_chat)(spark, path)


def generate(spark: SparkSession, sessions: int = 48, seed: int = 42) -> DataFrame:
    """A seeded fixture of chat records with the columns that ``chat_events`` reads; the same for every number of partitions."""
    h = lambda *c: F.pmod(F.xxhash64(F.lit(seed), *c), F.lit(1000))
    base = spark.range(sessions).withColumnRenamed("id", "s").withColumn("n", (6 + F.pmod(F.xxhash64(F.lit(seed), "s"), F.lit(20))).cast("int"))
    step = base.select("s", F.explode(F.sequence(F.lit(0), F.col("n"))).alias("k")).withColumn("r", h("s", "k"))
    sid = F.concat(F.lit("fixture-"), F.lpad(F.col("s").cast("string"), 8, "0"))
    empty = lambda **kw: F.struct(*[F.coalesce(kw[c], F.lit(None).cast(t)).alias(c) if c in kw else F.lit(None).cast(t).alias(c) for c, t in (x.split(" ") for x in _BLOCK.split(", "))])
    call_id = F.concat(F.lit("call-"), "s", F.lit("-"), F.col("k").cast("string"))
    ask = F.array(empty(type=F.lit("text"), text=F.concat(F.lit("Fix part "), F.col("r").cast("string"))))
    tool = F.array(empty(type=F.lit("tool_use"), id=call_id, name=F.element_at(F.array(*map(F.lit, ("Read", "Edit", "Bash"))), (F.pmod("r", F.lit(3)) + 1).cast("int")), input=F.concat(F.lit('{"command": "pytest part'), F.pmod("r", F.lit(7)).cast("string"), F.lit('"}'))))
    res = F.array(empty(type=F.lit("tool_result"), tool_use_id=F.concat(F.lit("call-"), "s", F.lit("-"), (F.col("k") - 1).cast("string")), content=F.lit("done"), is_error=F.col("r") < 300))
    turn = F.pmod("k", F.lit(4))
    content = F.when(turn == 0, ask).when(turn == 1, tool).when(turn == 2, res).otherwise(F.array(empty(type=F.lit("text"), text=F.lit("Done so far."))))
    role = F.when(turn.isin(0, 2), "user").otherwise("assistant")
    at = F.timestamp_seconds(F.lit(1_735_689_600) + F.col("s") * 86_400 + F.col("k") * 60)
    return step.select((F.col("s") * 1000 + F.col("k")).alias("row_id"), F.concat_ws("/", sid, F.col("k").cast("string")).alias("uuid"), sid.alias("sessionId"), F.lit(False).alias("isSidechain"), at.alias("ingested_at"), F.struct(role.alias("role"), content.alias("content")).alias("message"))


def empty(spark: SparkSession, ddl: str) -> DataFrame:
    return spark.createDataFrame([], T._parse_datatype_string(ddl))
