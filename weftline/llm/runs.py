"""Repeated consecutive events in sequences (problem 4): a streaming state machine over sorted chunks.

Events are sorted by (entity, time, place) and cut by range into chunks, so a hot entity is spread. In each chunk one
pass compares every event with the anchor of the open run: same signature, and no larger gap than ``max_gap_ms``.
Finished runs inside a chunk are emitted; the first and the last run of each chunk go through a second, tiny pass that
joins runs cut at a chunk border, exactly as if the stream had been one.

With a tolerance above 0 (``similar_runs``) an event may also differ from the anchor in a share of its words. What is
an anchor then depends on all events before, back to the last one that breaks any run: another tool or outcome, or a
larger gap. The stretches between such breaks are found first, by running values over bounded cuts of an entity; a
stretch is then one stream, with the open run as its only state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weftline.llm.records import ordered_chunks, role_of
from weftline.operators.instants import to_instants
from weftline.operators.stage import running, written

RUN = "entity string, anchor string, first_id string, last_id string, n bigint, first_ms bigint, last_ms bigint, chunk int, at_start boolean, at_end boolean"


def chunk_runs(max_gap_ms: int | None, least: int):
    """The state machine over one chunk; its state is the open run only."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunk = TaskContext.get().partitionId()
        cur = None  # entity, anchor, first_id, last_id, n, first_ms, last_ms
        start = True
        for pdf in batches:
            done = []
            for entity, anchor, ident, ms in zip(pdf["entity"].array, pdf["anchor"].array, pdf["ident"].array, pdf["ms"].array):
                ms = None if pd.isna(ms) else int(ms)
                if cur is not None and cur[0] == entity and anchor is not None and cur[1] == anchor and (
                    max_gap_ms is None or ms is None or cur[6] is None or ms - cur[6] <= max_gap_ms
                ):
                    cur[3], cur[4], cur[6] = ident, cur[4] + 1, ms
                    continue
                if cur is not None:
                    if start or cur[4] >= least:
                        done.append((*cur, chunk, start, False))
                    start = False
                cur = [entity, anchor, ident, ident, 1, ms, ms]
            if done:
                yield pd.DataFrame(done, columns=[c.split()[0] for c in RUN.split(", ")])
        if cur is not None:
            yield pd.DataFrame([(*cur, chunk, start, True)], columns=[c.split()[0] for c in RUN.split(", ")])

    return scan


def collapse_runs(events: DataFrame, max_gap_ms: int | None = None, least: int = 2, chunks: int | None = None) -> DataFrame:
    """One row per run of at least ``least`` events: (entity, first_id, last_id, n, first_ms, last_ms).

    ``events``: entity, anchor (null: belongs to no run and ends one), ident, ms, and the sort columns ms, place, tie.
    Rows without an entity are left out. An empty table gives no row. Times that are null do not break a run.
    """
    cols = [F.col("entity").cast("string"), F.col("anchor").cast("string"), F.col("ident").cast("string"), F.col("ms").cast("bigint"), "place", "tie"]
    ordered = ordered_chunks(events.where(F.col("entity").isNotNull()).select(*cols), ["entity", "ms", "tie", "place"], chunks)
    runs = written(ordered.select("entity", "anchor", "ident", "ms").mapInPandas(chunk_runs(max_gap_ms, least), RUN))
    edge = F.col("at_start") | F.col("at_end")
    # The edge runs are at most two a chunk. Chunks are numbered, so the sequence over all of them is their order.
    w = W.partitionBy("entity").orderBy("chunk", F.desc("at_start"))
    gap_ok = F.lit(True) if max_gap_ms is None else F.coalesce(F.col("first_ms") - F.lag("last_ms").over(w) <= max_gap_ms, F.lit(True))
    joins = F.lag("at_end").over(w) & F.col("at_start") & (F.lag("anchor").over(w) == F.col("anchor")) & gap_ok
    edges = runs.where(edge).withColumn("_new", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1))
    edges = edges.withColumn("_run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    order = F.struct("chunk", (~F.col("at_start")).alias("later"))
    merged = edges.groupBy("entity", "_run").agg(
        F.min_by("anchor", order).alias("anchor"), F.min_by("first_id", order).alias("first_id"), F.max_by("last_id", order).alias("last_id"),
        F.sum("n").alias("n"), F.min("first_ms").alias("first_ms"), F.max("last_ms").alias("last_ms"),
    ).drop("_run")
    inner = runs.where(~edge).select(*merged.columns)
    return inner.unionByName(merged).where(F.col("anchor").isNotNull() & (F.col("n") >= least)).drop("anchor")


def similar_runs(events: DataFrame, tolerance: float, max_gap_ms: int | None = None, least: int = 2) -> DataFrame:
    """As ``collapse_runs``, where an event belongs to the open run if the words of its input and of the run's anchor
    differ in at most ``tolerance`` of all their words (1 - Jaccard); 0 is equality of the sets.

    ``events``: entity, hard (tool and outcome; null: belongs to no run and ends one), words (hashes of the input's
    words), ident, ms (not null), place, tie. Rows without an entity are left out; two inputs without words are equal.
    """
    ev = written(events.where(F.col("entity").isNotNull()).select("entity", F.coalesce("hard", F.concat(F.lit("?"), F.col("tie").cast("string"), F.lit("/"), F.col("place").cast("string"))).alias("key"), F.col("hard").isNotNull().alias("counts"), "words", "ident", "ms", "place", "tie"))
    order = ["ms", "tie", "place"]
    seen = running(ev, "entity", "ms", order, lasts={"was": F.struct("key", "ms")}, before=True, width=86_400_000)
    far = F.lit(False) if max_gap_ms is None else F.coalesce(F.col("ms") - F.col("was.ms") > max_gap_ms, F.lit(False))
    fresh = F.when(F.col("was").isNull() | (F.col("was.key") != F.col("key")) | far, 1).otherwise(0)
    cut = running(written(seen.withColumn("fresh", fresh).drop("was")), "entity", "ms", order, sums={"stretch": F.col("fresh")}, width=86_400_000).where("counts")
    n = int(ev.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cur = None  # entity, stretch, words of the anchor, first, last, n, first_ms, last_ms
        for pdf in batches:
            done = []
            for entity, stretch, words, ident, ms in zip(pdf["entity"].array, pdf["stretch"].array, pdf["words"].array, pdf["ident"].array, pdf["ms"].array):
                own = frozenset(() if words is None else words)
                if cur is not None and cur[0] == entity and cur[1] == stretch and len(own & cur[2]) >= (1 - tolerance) * len(own | cur[2]):
                    cur[4], cur[5], cur[7] = ident, cur[5] + 1, ms
                    continue
                if cur is not None and cur[5] >= least:
                    done.append((cur[0], *cur[3:]))
                cur = [entity, stretch, own, ident, ident, 1, ms, ms]
            if done:
                yield pd.DataFrame(done, columns=["entity", "first_id", "last_id", "n", "first_ms", "last_ms"])
        if cur is not None and cur[5] >= least:
            yield pd.DataFrame([(cur[0], *cur[3:])], columns=["entity", "first_id", "last_id", "n", "first_ms", "last_ms"])

    rows = cut.select("entity", "stretch", "words", "ident", "ms", "place", "tie").repartition(n, "entity", "stretch").sortWithinPartitions("entity", "stretch", *order)
    return rows.mapInPandas(scan, "entity string, first_id string, last_id string, n bigint, first_ms bigint, last_ms bigint")


def input_signature(text: Column) -> Column:
    """A call's input without what does not make a call another one: key order, blank space, and values of times, hex ids and numbers.

    JSON gets its keys in order at every level; text that is not JSON is taken as it is. Null and blank give ''.
    """
    canonical = F.coalesce(F.to_json(F.try_parse_json(text)), text)
    s = F.regexp_replace(canonical, r"\\[nrtf]|[\s\p{Z}]+", " ")
    s = F.regexp_replace(s, r"(?<![0-9A-Za-z])[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}(?![0-9A-Za-z])", "#")
    s = F.regexp_replace(s, r"(?<![0-9A-Za-z])\d{4}-\d{2}-\d{2}(?:[T ]?\d{2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?(?: ?(?:Z|UTC|[+-]\d{2}:?\d{2}))?)?(?![0-9A-Za-z])", "#")
    s = F.regexp_replace(s, r"(?<![0-9A-Za-z])\d{1,2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?(?![0-9A-Za-z])", "#")
    s = F.regexp_replace(s, r"(?<![0-9A-Za-z])(?:0[xX][0-9A-Fa-f]+|(?=[A-Fa-f]*[0-9])[0-9A-Fa-f]{6,})(?![0-9A-Za-z])", "#")
    s = F.regexp_replace(s, r"\d+(?:[.,]\d+)?(?:[eE][+-]?\d+)?", "#")
    return F.coalesce(F.regexp_replace(s, " ", ""), F.lit(""))


def signature_words(text: Column) -> Column:
    """Hashes of the distinct words of an input's signature."""
    return F.array_distinct(F.transform(F.filter(F.split(input_signature(text), r"[^A-Za-z0-9#_.-]+"), lambda w: w != ""), lambda w: F.xxhash64(w)))


def compact(claude: DataFrame, words: bool = False) -> DataFrame:
    """The main-chain records of sessions, each with its blocks cut down to what runs need; the one reading of the log.

    A block is (kind, ident, sig, err): a call with its id and the hash of tool and input, a result with the id of its
    call and its error flag, a text of the person. Other blocks fall away, records stay: they date those that follow.
    """
    main = claude.where(F.col("sessionId").isNotNull() & ~F.coalesce("isSidechain", F.lit(False)))
    person = F.coalesce(role_of(F.col("message.role")), F.col("type")) == "user"
    filled = lambda b: F.coalesce(b["text"].rlike(r"[^\s\p{Z}]"), F.lit(False))
    kind = lambda b: F.when(b["type"] == "tool_use", "call").when(b["type"] == "tool_result", "result").when((b["type"] == "text") & person & filled(b), "person")
    sig = lambda b: F.when(b["type"] == "tool_use", F.unhex(F.md5(F.concat_ws("\x1f", F.lower(F.trim(b["name"])), input_signature(b["input"])))))
    slim = F.transform("message.content", lambda b, k: F.struct(k.alias("place"), kind(b).alias("kind"), F.coalesce(b["id"], b["tool_use_id"]).alias("ident"), sig(b).alias("sig"), F.coalesce(b["is_error"], F.lit(False)).alias("err"), *([F.lower(F.trim(b["name"])).alias("tool"), F.when(b["type"] == "tool_use", signature_words(b["input"])).alias("words")] if words else [])))
    blocks = F.filter(slim, lambda b: b["kind"].isNotNull())
    uuid = F.coalesce("uuid", F.concat(F.lit("row:"), F.col("row_id").cast("string")))
    return main.select("row_id", uuid.alias("uuid"), "parentUuid", F.col("sessionId").alias("entity"), "timestamp", "machine", F.unix_millis(F.col("ingested_at").cast("timestamp")).alias("delivered"), blocks.alias("blocks"))


def call_events(claude: DataFrame, machines: DataFrame, words: bool = False) -> DataFrame:
    """The calls of the main chain and the texts of the person as events of their session.

    A doubled record counts once (by uuid; the first delivery stands). A record without an instant takes that of the
    record it follows, or else that of its delivery. A call without a result, and a text of the person, have a null
    anchor. With ``words`` the columns are those of ``similar_runs``.
    """
    rec = written(to_instants(compact(claude, words), "timestamp", machines).drop("timestamp", "machine"))
    speaks = F.exists("blocks", lambda b: b["kind"] != "result")
    undated = rec.where(F.col("utc_ms").isNull() & speaks)
    lost = undated.where(F.col("parentUuid").isNotNull()).select(F.col("parentUuid").alias("uuid")).distinct()
    near = rec.where("utc_ms is not null").join(lost, "uuid", "left_semi").groupBy(F.col("uuid").alias("parentUuid")).agg(F.min("utc_ms").alias("near"))
    filled = undated.join(near, "parentUuid", "left").withColumn("utc_ms", F.coalesce("near", "delivered"))
    dated = rec.where(F.col("utc_ms").isNotNull() & speaks).unionByName(filled.select(*rec.columns))
    each = dated.select("entity", "uuid", "row_id", F.col("utc_ms").alias("ms"), F.explode(F.filter("blocks", lambda b: b["kind"] != "result")).alias("b"))
    each = each.select("entity", "uuid", "row_id", "ms", "b.*")
    event = each.groupBy("entity", "uuid", "place").agg(F.min_by(F.struct("ident", "sig", "ms", "row_id", *(["tool", "words"] if words else [])), "row_id").alias("e")).select("entity", "place", "e.*")
    result = rec.select("entity", "row_id", F.explode(F.filter("blocks", lambda b: (b["kind"] == "result") & b["ident"].isNotNull())).alias("b"))
    result = result.groupBy("entity", F.col("b.ident").alias("ident")).agg(F.min_by("b.err", "row_id").alias("outcome"))
    calls = event.where("sig is not null and ident is not null").join(result, ["entity", "ident"], "left")
    if words:
        hard = F.when(F.col("outcome").isNotNull(), F.concat_ws("/", F.coalesce("tool", F.lit("")), F.col("outcome").cast("string")))
        breaks = event.where("sig is null or ident is null").select("entity", F.lit(None).cast("string").alias("hard"), F.lit(None).cast("array<bigint>").alias("words"), F.lit(None).cast("string").alias("ident"), "ms", "place", F.col("row_id").alias("tie"))
        return calls.select("entity", hard.alias("hard"), "words", "ident", "ms", "place", F.col("row_id").alias("tie")).unionByName(breaks)
    anchor = F.when(F.col("outcome").isNotNull(), F.concat_ws("/", F.hex("sig"), F.col("outcome").cast("string")))
    calls = calls.select("entity", anchor.alias("anchor"), "ident", "ms", "place", F.col("row_id").alias("tie"))
    breaks = event.where("sig is null or ident is null").select("entity", F.lit(None).cast("string").alias("anchor"), F.lit(None).cast("string").alias("ident"), "ms", "place", F.col("row_id").alias("tie"))
    return calls.unionByName(breaks)
