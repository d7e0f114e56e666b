"""Mixing sources to target weights (problem 9): Sainte-Lague apportionment of equal-token blocks.

1. The total is cut into seats of ``block`` tokens. They go one by one to the source with the highest quotient
   share / (2 seats + 1), as long as the source has tokens left within its repeats.
2. The documents of a source fall into shards of about ``SHARD_TOKENS`` tokens by a seeded hash, as many as its tokens
   ask for. In its shard, in seeded order, documents are laid end to end and cut into blocks of ``block`` tokens.
3. A source's seats go to its shards by the same rule, found over all shards at once by its divisor: a shard with t
   tokens gets t / d seats, rounded.
4. Of a shard, blocks are drawn in seeded order until its quota is met: whole passes first, then a part of one more
   pass, so no document is used more often than its source allows.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weftline.operators.stage import written

#: Most target sources, which the driver holds; more raise an error. Tokens of a shard, which one task lays end to end.
MOST_SOURCES, SHARD_TOKENS = 1000, 500_000


def source_name(c):
    """A source in one spelling: lower case, trimmed, parts joined by '_'; null for null and blank."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(c)), r"[\s-]+", "_"), F.lit(""))


def apportion(weights: list[float], caps: list[int], seats: int) -> list[int]:
    """Seats by highest quotient weight / (2 k + 1), none beyond its cap; at a tie the first. Stops when all are full."""
    got = [0] * len(weights)
    heap = [(-w, i) for i, w in enumerate(weights) if w > 0 and caps[i] > 0]
    heapq.heapify(heap)
    while seats and heap:
        _, i = heapq.heappop(heap)
        got[i] += 1
        seats -= 1
        if got[i] < caps[i]:
            heapq.heappush(heap, (-weights[i] / (2 * got[i] + 1), i))
    return got


def shard_seats(shards: DataFrame, seats: dict[str, int], have: dict[str, int]) -> DataFrame:
    """(source, shard, seats) of ``shards`` (source, shard, t): each source's seats by its shards' tokens.

    Sixteen divisors of each source are tried in one pass over the shards and the range between two is tried again,
    until it is tight; the few seats that are then left go to the shards with the highest quotients.
    """
    bound = {s: (have[s] / n / 2, have[s] / n * 2) for s, n in seats.items() if n > 0}
    best: dict[str, tuple[float, int]] = {}
    for _ in range(6):
        tries = {s: [lo + (hi - lo) * (i + 0.5) / 16 for i in range(16)] + ([have[s] / seats[s]] if s not in best else []) for s, (lo, hi) in bound.items() if best.get(s, (0, -1))[1] != seats[s]}
        if not tries:
            break
        at = F.try_element_at(F.create_map(*[x for s, ds in tries.items() for x in (F.lit(s), F.array(*map(F.lit, ds)))]), F.col("source"))
        sums = shards.select("source", "t", F.explode(at).alias("d")).groupBy("source", "d").agg(F.sum(F.floor(F.col("t") / F.col("d") + 0.5)).alias("n")).collect()
        for s, ds in tries.items():
            got = sorted((r["d"], int(r["n"])) for r in sums if r["source"] == s)
            fits = [(d, n) for d, n in got if n <= seats[s]]
            over = [d for d, n in got if n > seats[s]]
            if fits and (s not in best or fits[0][1] > best[s][1]):
                best[s] = fits[0]
            bound[s] = (max(over, default=bound[s][0]), fits[0][0] if fits else bound[s][1])
    divisor = F.try_element_at(F.create_map(*[F.lit(x) for s in bound for x in (s, best.get(s, (bound[s][1], 0))[0])]), F.col("source"))
    got = shards.select("source", "shard", "t", F.coalesce(F.floor(F.col("t") / divisor + 0.5), F.lit(0)).cast("bigint").alias("seats"))
    short = {r[0]: seats[r[0]] - int(r[1]) for r in got.where(F.col("source").isin(list(bound))).groupBy("source").agg(F.sum("seats")).collect()}
    more = None
    for s, n in short.items():
        if n > 0:
            top = got.where(F.col("source") == s).orderBy(F.desc(F.col("t") / (2 * F.col("seats") + 1)), "shard").limit(n).select("source", "shard")
            more = top if more is None else more.unionByName(top)
    if more is None:
        return got
    return got.join(more.withColumn("one", F.lit(1)), ["source", "shard"], "left").select("source", "shard", "t", (F.col("seats") + F.coalesce("one", F.lit(0))).alias("seats"))


def draw(sizes: DataFrame, targets: DataFrame, total: int | None = None, block: int | None = None, seed: int = 7) -> DataFrame:
    """(doc_id, source, n_tokens, repeats, quota) of the documents drawn; ``quota`` is what their shard was to give.

    ``sizes``: doc_id, source, n_tokens. ``targets``: source, target_share, max_repeats. Shares that are null or not
    positive get nothing, null repeats count as one. Documents of no target source and documents without tokens are not
    drawn. ``total`` is by default the largest total at which every source that has documents can give its share
    within its repeats. Targets without any document leave their share to the others. Empty tables draw nothing.
    """
    goal = (
        targets.select(source_name(F.col("source")).alias("source"), "target_share", F.coalesce("max_repeats", F.lit(1)).alias("max_repeats"))
        .where(F.col("source").isNotNull() & (F.col("target_share") > 0) & (F.col("max_repeats") > 0))
        .groupBy("source").agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("repeats")).orderBy("source").take(MOST_SOURCES + 1)
    )
    if len(goal) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} target sources")
    docs = sizes.select("doc_id", source_name(F.col("source")).alias("source"), "n_tokens").where(F.col("source").isin([g["source"] for g in goal]) & (F.col("n_tokens") > 0))
    have = {r[0]: r[1] for r in docs.groupBy("source").agg(F.sum("n_tokens")).collect()}  # one row per target source
    live = [g for g in goal if have.get(g["source"], 0) > 0]
    if not live:
        return docs.where("false").select("doc_id", "source", "n_tokens", F.lit(1).alias("repeats"), F.lit(0).cast("bigint").alias("quota"))
    share = sum(g["share"] for g in live)
    total = total or int(min(have[g["source"]] * g["repeats"] / (g["share"] / share) for g in live))
    block = block or max(1, total // 20_000)
    got = apportion([g["share"] for g in live], [have[g["source"]] * g["repeats"] // block for g in live], total // block)
    seats = {g["source"]: n for g, n in zip(live, got)}
    of = lambda values: F.element_at(F.create_map(*[F.lit(x) for s, v in values.items() for x in (s, v)]), F.col("source"))
    shard = F.pmod(F.xxhash64("doc_id", F.lit(seed)), of({s: -(-have[s] // SHARD_TOKENS) for s in seats}))
    order = W.partitionBy("source", "shard").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id").rowsBetween(W.unboundedPreceding, -1)
    laid = written(docs.where(F.col("source").isin(list(seats))).withColumn("shard", shard).withColumn("block", F.floor(F.coalesce(F.sum("n_tokens").over(order), F.lit(0)) / block)))
    blocks = written(laid.groupBy("source", "shard", "block").agg(F.sum("n_tokens").alias("size")))
    shards = written(blocks.groupBy("source", "shard").agg(F.sum("size").alias("t")))
    quota = shard_seats(shards, seats, have).select("source", "shard", "t", F.least(F.col("seats") * block, F.col("t") * of({g["source"]: int(g["repeats"]) for g in live})).alias("quota"))
    seeded = W.partitionBy("source", "shard").orderBy(F.xxhash64("block", F.lit(seed + 2)), "block").rowsBetween(W.unboundedPreceding, -1)
    drawn = blocks.join(quota, ["source", "shard"]).withColumn("before", F.coalesce(F.sum("size").over(seeded), F.lit(0)))
    passes = F.expr("quota div t")
    extra = (F.col("before") + F.col("size") / 2 <= F.col("quota") - passes * F.col("t")).cast("bigint")
    drawn = drawn.select("source", "shard", "block", "quota", (passes + extra).cast("int").alias("repeats")).where("repeats > 0")
    return laid.join(drawn, ["source", "shard", "block"]).select("doc_id", "source", "n_tokens", "repeats", "quota")


def shares(drawn: DataFrame, sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, available_tokens, drawn_tokens, actual_share, most_repeats) of every target source."""
    goal = targets.select(source_name(F.col("source")).alias("source"), "target_share").where(F.col("source").isNotNull()).groupBy("source").agg(F.sum("target_share").alias("target_share"))
    have = sizes.groupBy(source_name(F.col("source")).alias("source")).agg(F.sum("n_tokens").alias("available_tokens"))
    got = drawn.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("drawn_tokens"), F.max("repeats").alias("most_repeats"))
    row = goal.join(have, "source", "left").join(got, "source", "left").fillna(0, ["available_tokens", "drawn_tokens", "most_repeats"])
    return row.withColumn("actual_share", F.col("drawn_tokens") / F.nullif(F.sum("drawn_tokens").over(W.partitionBy(F.lit(0))), F.lit(0))).select("source", "target_share", "available_tokens", "drawn_tokens", "actual_share", "most_repeats")
