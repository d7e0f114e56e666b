"""Rebuilding conversations from message rows (problem 7) by assembly of overlapping fragments.

A record says its own key and that of the record before it; hashes of these are what fragments overlap in. Records are
sorted by (session, time, delivery) and cut by range into chunks. In a chunk, records whose predecessor is the record
at hand are appended to a fragment; a fragment's prefix is the hash of its head's parent, its suffix the hash of its
tail. Over all fragments, a suffix that equals the prefix of exactly one fragment is an unambiguous overlap; paths of
such overlaps are merged by pointer doubling. Paths of a session follow each other by time. A parent that is nowhere in
the table is a gap, and a session with one is dropped whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weftline.llm.records import has_text, ordered_chunks, plain_session, role_of
from weftline.operators.instants import to_instants
from weftline.operators.stage import running, salted_left_join, written
from weftline.plans.instants import session_machines

PIECE = "session string, key string, record string, parent string, ms bigint, role string, spoken boolean, fragment string, place bigint"


def chunk_fragments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Adds to each record its fragment and its place in it. State: the tails of the open session's fragments in this chunk."""
    chunk = TaskContext.get().partitionId()
    session, tails, made = None, {}, 0
    for pdf in batches:
        fragment, place = [], []
        for s, key, parent in zip(pdf["session"].array, pdf["key"].array, pdf["parent"].array):
            if s != session:
                session, tails = s, {}
            got = None if parent is None else tails.pop(parent, None)
            if got is None:
                made += 1
                got = (f"{chunk}-{made}", -1)
            tails[key] = (got[0], got[1] + 1)
            fragment.append(got[0])
            place.append(got[1] + 1)
        yield pdf.assign(fragment=fragment, place=place)


def rank_paths(nodes: DataFrame, before: DataFrame) -> DataFrame:
    """(fragment, path, depth): the first fragment of each one's path and the steps from it, by pointer doubling.

    ``before`` (fragment, before) names at most one predecessor. Every round halves what is left of each path; a round
    that finishes no fragment has only rings left (parents that follow each other in a circle), whose fragments become
    paths of their own.
    """
    state = written(nodes.join(before, "fragment", "left").select(
        "fragment", F.coalesce("before", "fragment").alias("path"), F.col("before").isNotNull().cast("bigint").alias("depth"), F.col("before").isNull().alias("done"),
    ))
    left = state.where("not done").count()
    while left:
        far = state.select(F.col("fragment").alias("path"), F.col("path").alias("far"), F.col("depth").alias("more"), F.col("done").alias("far_done"))
        moved = state.where("not done").join(far, "path").select("fragment", F.col("far").alias("path"), (F.col("depth") + F.col("more")).alias("depth"), F.col("far_done").alias("done"))
        state = written(state.where("done").unionByName(moved))
        now = state.where("not done").count()
        if now == left:
            state = state.select("fragment", F.when(F.col("done"), F.col("path")).otherwise(F.col("fragment")).alias("path"), F.when(F.col("done"), F.col("depth")).otherwise(0).alias("depth"))
            break
        left = now
    return state.select("fragment", "path", "depth")


def assemble(records: DataFrame, chunks: int | None = None) -> DataFrame:
    """Turns of the conversations kept: (session, record, turn_no).

    ``records``: session, record, parent (both texts), ms, tie, role (user, assistant, other, null), spoken (has a text
    that is not blank). A doubled record is one: its first delivery (least tie) stands. Rows without a session or a
    record key join no conversation, but their keys still count as parents that exist. Dropped are conversations
    without a turn, that do not begin with the user or end with the assistant, that hold a text of an unreadable role,
    or a record whose parent is nowhere in the table.
    """
    h = lambda c: F.hex(F.xxhash64(F.col(c)))  # noqa: E731  # as text: pandas has no whole numbers beside nulls
    one = records.where(F.col("record").isNotNull()).groupBy("record").agg(*[F.min_by(c, "tie").alias(c) for c in ("session", "parent", "ms", "role", "spoken")], F.min("tie").alias("tie"))
    one = written(one)
    has_parent = one.where(F.coalesce(F.col("parent") != "", F.lit(False)) & F.col("session").isNotNull())
    gaps = has_parent.join(one.select(F.col("record").alias("parent")), "parent", "left_anti").select("session").distinct()
    own = one.where("session is not null").withColumn("key", h("record")).withColumn("up", F.when(F.col("parent") != "", h("parent")))
    sorted_ = ordered_chunks(own.select("session", "key", "record", F.col("up").alias("parent"), "ms", "role", "spoken", "tie"), ["session", "ms", "tie"], chunks, keep=False).drop("tie")
    pieces = written(sorted_.mapInPandas(chunk_fragments, PIECE))
    turn = F.col("spoken") & F.col("role").isin("user", "assistant")
    w = F.struct("place")
    fragments = written(pieces.groupBy("session", "fragment").agg(
        F.min_by("parent", w).alias("prefix"), F.max_by("key", w).alias("suffix"), F.min("ms").alias("ms"), F.min_by("key", w).alias("head"),
        F.count_if(turn).alias("turns"), F.min_by(F.when(turn, F.col("role")), F.when(turn, F.col("place"))).alias("first_role"),
        F.max_by(F.when(turn, F.col("role")), F.when(turn, F.col("place"))).alias("last_role"),
        F.count_if(F.col("spoken") & F.col("role").isNull()).alias("unreadable"),
    ))
    # Unambiguous overlaps: the suffix of one fragment is the prefix of exactly one other fragment of the session.
    after = fragments.where("prefix is not null").groupBy("session", F.col("prefix").alias("suffix")).agg(F.count("*").alias("n"), F.min("fragment").alias("next")).where("n = 1").drop("n")
    pairs = fragments.select("session", "suffix", "fragment").join(after, ["session", "suffix"]).where("fragment <> next")
    paths = rank_paths(fragments.select("fragment"), pairs.select(F.col("next").alias("fragment"), F.col("fragment").alias("before")))
    f = fragments.join(paths, "fragment")
    start = f.where("depth = 0").select(F.col("fragment").alias("path"), F.col("ms").alias("path_ms"))
    f = f.join(start, "path", "left")
    order = F.struct(F.coalesce("path_ms", "ms", F.lit(0).cast("bigint")).alias("a"), F.col("path").alias("b"), F.col("depth").alias("c"))
    f = f.withColumn("at", F.coalesce("path_ms", "ms", F.lit(0).cast("bigint")))
    f = written(running(f, "session", "at", ["at", "path", "depth"], sums={"before": F.col("turns")}, before=True, width=86_400_000).withColumn("order", order))
    spoke = F.col("turns") > 0
    kept = f.groupBy("session").agg(
        F.sum("turns").alias("turns"), F.sum("unreadable").alias("unreadable"),
        F.min_by("first_role", F.when(spoke, F.col("order"))).alias("first_role"), F.max_by("last_role", F.when(spoke, F.col("order"))).alias("last_role"),
    ).where("turns > 0 and unreadable = 0 and first_role = 'user' and last_role = 'assistant'").join(gaps, "session", "left_anti")
    good = f.join(kept.select("session"), "session", "left_semi").select("fragment", "before")
    inside = W.partitionBy("fragment").orderBy("place")
    spoken = pieces.where(turn).join(good, "fragment")
    return spoken.select("session", "record", (F.col("before") + F.row_number().over(inside)).cast("int").alias("turn_no"))


def judgment_records(table: DataFrame, machines: DataFrame) -> DataFrame:
    """Records of a chat log for ``assemble``."""
    timed = to_instants(table.select("row_id", "uuid", "parentUuid", "sessionId", "timestamp", "machine", "ingested_at", "message.role", "message.content"), "timestamp", machines)
    return timed.select(
        plain_session(F.col("sessionId")).alias("session"), F.col("uuid").alias("record"), F.col("parentUuid").alias("parent"),
        F.coalesce("utc_ms", F.unix_millis(F.col("ingested_at").cast("timestamp"))).alias("ms"), F.col("row_id").alias("tie"),
        role_of(F.col("role")).alias("role"), has_text(F.col("content")).alias("spoken"),
    )


def store_records(messages: DataFrame, parts: DataFrame, sessions: DataFrame, machines: DataFrame) -> DataFrame:
    """Records of the message store for ``assemble``; the shapes of ``data`` over time are read by fallback paths."""
    v = F.try_parse_json(F.col("data"))
    read = lambda *paths: F.coalesce(*[F.try_variant_get(F.col("v"), p, "string") for p in paths])
    m = messages.select("row_id", "id", "session_id", "time_created", v.alias("v")).select(
        "row_id", "id", "session_id", "time_created", read("$.role", "$.info.role", "$.author.role").alias("role"),
        read("$.parentID", "$.info.parent_id", "$.parent", "$.parent_id", "$.info.parentID").alias("parent"),
    )
    m = salted_left_join(m, session_machines(sessions), ["session_id"])
    m = to_instants(m, "time_created", machines)
    p = parts.select("message_id", "time_created", F.try_parse_json(F.col("data")).alias("v"))
    text = F.when(F.try_variant_get(F.col("v"), "$.type", "string") == "text", F.try_variant_get(F.col("v"), "$.text", "string"))
    spoken = p.where(F.col("message_id").isNotNull()).groupBy(F.col("message_id").alias("id")).agg(F.max(F.coalesce(text.rlike(r"[^\s\p{Z}]"), F.lit(False))).alias("spoken"), F.min("time_created").alias("part_ms"))
    m = m.join(spoken, "id", "left")
    return m.select(
        F.nullif(F.trim("session_id"), F.lit("")).alias("session"), F.col("id").alias("record"), "parent", F.coalesce("utc_ms", "part_ms", F.lit(0)).alias("ms"),
        F.col("row_id").alias("tie"), role_of(F.col("role")).alias("role"), F.coalesce("spoken", F.lit(False)).alias("spoken"),
    )
