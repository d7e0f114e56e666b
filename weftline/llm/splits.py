"""Splits that keep related records together: grouped iterative stratification (problem 3).

1. Sessions are linked when a message id occurs in both or a record follows a record of the other.
2. Components of the link graph come from min-label propagation with pointer shortcuts; each round is one join of the
   edges with the labels, spread by salts, and is written so that a lost executor loses nothing.
3. Each component has a vector of label counts. The label with the fewest records outstanding comes first, over all
   data: its components fall into classes by how many of its records they hold, largest first, and each class gets
   whole quotas per split, every place to the split that needs this label most. Members take the places of their class
   in seeded order. Then what the placed components hold of other labels is taken off what is needed, and the next
   label comes. Nothing is placed in blocks, so a label of few records is spread as its shares ask.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.records import plain_session, role_of
from weftline.operators.graph import connected_components
from weftline.operators.stage import running, salted_left_join, written

#: Most splits and labels: what the driver holds is their product. More raise an error; none is dropped.
MOST_SPLITS, MOST_LABELS = 100, 1000
# Permission modes of chat records; others are one label.
MODES = ("default", "acceptedits", "plan", "bypasspermissions", "auto", "dontask")

#: Words that stand for a missing id, alone or after a prefix such as ``msg_``.
MISSING = ("unknown", "synthetic", "null", "none", "nil", "nan", "na", "undefined", "missing", "empty", "blank", "placeholder", "dummy")


def real_id(c):
    """A message id, or null where its form is that of a stand-in for a missing one: blank, a word of ``MISSING``, or one
    repeated character; each alone or after the prefix of a message id. What digits a real id holds is chance."""
    t = F.trim(c)
    bare = F.regexp_replace(F.lower(t), r"[\s\p{P}\p{S}]", "")
    return F.when(~bare.rlike(rf"^(?:msg(?:01)?|message|id)?(?:(.)\1*|{'|'.join(MISSING)})?$"), t)


def session_links(records: DataFrame) -> DataFrame:
    """Undirected links (a, b), a < b, of nodes; ``records`` holds node, uuid, parent, message_id.

    Sessions that share a message id are linked to the least of them: as many links as members, not all pairs.
    """
    held = records.where(F.col("message_id").isNotNull()).select("message_id", "node").distinct()
    least = held.groupBy("message_id").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    by_message = held.join(least, "message_id").select("a", F.col("node").alias("b"))
    owner = records.where(F.col("uuid").isNotNull()).select(F.col("uuid").alias("parent"), F.col("node").alias("a")).distinct()
    follows = records.where(F.col("parent").isNotNull()).select("parent", F.col("node").alias("b")).distinct()
    by_parent = follows.join(owner, "parent").select("a", "b")
    both = by_message.unionByName(by_parent).where("a <> b")
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def judgment_nodes(table: DataFrame) -> DataFrame:
    """Records as (row_id, uuid, parent, message_id, session, node, label, role and permission); a record without a session is a node of its own uuid."""
    session = plain_session(F.col("sessionId"))
    return table.select(
        "row_id", "uuid", F.col("parentUuid").alias("parent"), real_id(F.col("message.id")).alias("message_id"), session.alias("session"),
        F.coalesce(session, F.concat(F.lit("record:"), F.coalesce("uuid", F.col("row_id").cast("string")))).alias("node"),
        F.concat_ws("/", F.coalesce(role_of(F.col("message.role")), F.lit("unreadable")), F.when(F.lower(F.trim("permissionMode")).isin(*MODES), F.lower(F.trim("permissionMode"))).when(F.col("permissionMode").isNull(), "-").otherwise("other")).alias("label"),
    )


def linked_pairs(records: DataFrame) -> DataFrame:
    """All pairs session_a < session_b of different sessions of one component, as the definition of the case list asks."""
    session = records.where(F.col("session").isNotNull())
    c = connected_components(session_links(session.withColumn("node", F.col("session"))))
    a = c.select("component", F.col("node").alias("session_a"))
    b = c.select("component", F.col("node").alias("session_b"))
    return a.join(b, "component").where("session_a < session_b").select("session_a", "session_b")


def quotas(need: list[float], total: list[float], size: int, members: int) -> list[int]:
    """How many of ``members`` groups with ``size`` records of a label each split gets.

    Each place goes to the split that needs most of the label, of equal needs to the one that needs most records; what
    all splits need after the last place differs by one group at most, so places are counted, not dealt one by one,
    as long as many are left.
    """
    left, got = list(need), [0] * len(need)
    while members > 4 * len(need):  # whole rounds: lower every split to a common level that uses up half of the places
        high = max(left)
        low = high - size * members
        for _ in range(80):
            level = (high + low) / 2
            if sum(max(0, int((x - level) // size)) for x in left) > members - 2 * len(need):
                low = level
            else:
                high = level
        take = [max(0, int((x - high) // size)) for x in left]
        if not any(take):
            break
        for i, n in enumerate(take):
            got[i], left[i], members = got[i] + n, left[i] - n * size, members - n
    heap = [(-x, -total[i], i) for i, x in enumerate(left)]
    heapq.heapify(heap)
    for _ in range(members):
        x, t, i = heapq.heappop(heap)
        got[i] += 1
        heapq.heappush(heap, (x + size, t + size, i))
    return got


def assign_splits(records: DataFrame, targets: DataFrame, seed: int = 7) -> DataFrame:
    """``records`` (node, label and any other columns) with ``split_name``; a node's component goes to one split.

    ``targets`` (split_name, target_share) is a small fixed table. Shares that are null or not positive get nothing; an
    empty target table gives null splits. Records keep their columns; none is dropped or repeated. The driver holds a
    number per split and label, and of the label at hand the counts of its class sizes, of which there are at most
    sqrt(2 n) for n records.
    """
    goal = targets.where(F.col("split_name").isNotNull() & (F.col("target_share") > 0)).groupBy("split_name").agg(F.sum("target_share").alias("s")).orderBy("split_name").take(MOST_SPLITS + 1)
    if not goal:
        return records.withColumn("split_name", F.lit(None).cast("string"))
    names, whole = [r[0] for r in goal], sum(r[1] for r in goal)
    comp = connected_components(session_links(records))
    per_node = records.groupBy("node", "label").agg(F.count("*").alias("n"))
    tagged = salted_left_join(per_node, comp, ["node"]).withColumn("component", F.coalesce("component", "node"))
    sizes = written(tagged.groupBy("component", F.coalesce("label", F.lit("")).alias("label")).agg(F.sum("n").alias("n")))
    outstanding = {r[0]: r[1] for r in sizes.groupBy("label").agg(F.sum("n")).take(MOST_LABELS + 1)}
    if len(names) > MOST_SPLITS or len(outstanding) > MOST_LABELS:
        raise ValueError(f"more than {MOST_SPLITS} splits or {MOST_LABELS} labels")
    need = {(i, k): n * r[1] / whole for k, n in outstanding.items() for i, r in enumerate(goal)}
    open_ = written(sizes.groupBy("component").agg(F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("has")))  # at most MOST_LABELS entries
    placed = None
    for _ in range(len(outstanding)):
        live = [k for k, n in outstanding.items() if n > 0]
        if not live:
            break
        k = min(live, key=lambda x: (outstanding[x], x))
        mine = open_.withColumn("size", F.coalesce(F.try_element_at("has", F.lit(k)), F.lit(0))).where("size > 0")
        dealt = []
        for size, members in sorted(((r[0], r[1]) for r in mine.groupBy("size").agg(F.count("*")).collect()), reverse=True):
            got = quotas([need[i, k] for i in range(len(names))], [sum(need[i, x] for x in outstanding) for i in range(len(names))], size, members)
            at = 0
            for i, n in enumerate(got):
                dealt += [(size, at, at + n, i)] * (n > 0)
                at += n
                need[i, k] -= n * size
        for i in range(len(names)):  # what was placed is counted in full below
            need[i, k] += sum((b - a) * size for size, a, b, j in dealt if j == i)
        places = records.sparkSession.createDataFrame(dealt, "size bigint, a bigint, b bigint, split int")
        seeded = mine.withColumn("h", F.xxhash64("component", F.lit(seed)))
        ranked = running(seeded, "size", "h", ["h", "component"], sums={"rank": F.lit(1).cast("bigint")}, width=1 << 54)
        new = written(ranked.join(places, "size").where((F.col("rank") > F.col("a")) & (F.col("rank") <= F.col("b"))).select("component", "has", "split"))
        for r in new.select("split", F.explode("has").alias("label", "n")).groupBy("split", "label").agg(F.sum("n").alias("n")).collect():
            need[r[0], r[1]] -= r[2]
            outstanding[r[1]] -= r[2]
        chosen = new.select("component", "split")
        placed = chosen if placed is None else placed.unionByName(chosen)
        open_ = written(open_.where(F.coalesce(F.try_element_at("has", F.lit(k)), F.lit(0)) <= 0))
    if placed is None:
        return records.withColumn("split_name", F.lit(None).cast("string"))
    named = placed.select("component", F.element_at(F.array(*map(F.lit, names)), F.col("split") + 1).alias("split_name"))
    return salted_left_join(salted_left_join(records, comp, ["node"]).withColumn("component", F.coalesce("component", "node")), named, ["component"]).drop("component")
