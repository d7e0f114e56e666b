"""Consensus from several labelers (problem 2): spectral reliability weighs votes.

Two labelers who share items form a cell of the agreement matrix: their agreement on the shared items, less what chance
gives by what each of them says on those items, divided by the number of shared items (with ``SHRINK`` pseudo items
without agreement, so that a pair that shares few says little). Cells exist only for pairs that share an item; the
matrix is a sparse table. Its leading eigenvector comes from power iteration by joins of that table with the vector,
until it moves by less than ``SETTLED``. For labelers who err independently the matrix is close to r r', so the
eigenvector, scaled to fit the cells best, is each labeler's reliability r: 0 for one who guesses, 1 for one who is
always right. A vote counts as the log odds that r gives it, and the word with most weight is the consensus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weftline.operators.stage import written

# The codebook, and how other words map onto it.
CODEBOOK = {
    "origin": ("asked", "plan", "found", "recovery", "wall", "scheduled"),
    "status": ("done", "dropped", "parked", "open", "unclear"),
    "boundary": ("right", "too_big", "too_small", "not_a_thread"),
}
SYNONYMS = {
    "origin": {"ask": "asked", "schedule": "scheduled", "agent": "plan"},
    "status": {"outcome": "done", "abandoned": "dropped", "outcome?": "unclear"},
    "boundary": {},
}
K = max(map(len, CODEBOOK.values()))
#: Pseudo items without agreement of each pair, and how little the eigenvector has to move to be settled.
SHRINK, SETTLED = 2.0, 1e-5


def code_of(field: str, c: Column) -> Column:
    """Index of a word in the codebook of ``field``; null for null, blank and unknown words."""
    word = F.regexp_replace(F.lower(F.trim(c)), r"[\s-]+", "_")
    known = {w: i for i, w in enumerate(CODEBOOK[field])} | {w: CODEBOOK[field].index(t) for w, t in SYNONYMS[field].items()}
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), word)


def votes_of(labels: DataFrame) -> DataFrame:
    """One vote per item, labeler and field: (item, field, labeler, v), the first that is readable.

    A later label of the same person repeats the first from memory and is no second opinion. Rows without an item or a
    labeler give no vote.
    """
    one = labels.where(F.col("item_key").isNotNull() & F.col("labeler").isNotNull()).select(
        F.col("item_key").alias("item"), "labeler", F.struct(F.coalesce("is_repeat", F.lit(False)), F.coalesce("labeled_at", F.lit("9999-12-31").cast("timestamp")), "label_id").alias("o"),
        *[code_of(f, F.col(f)).alias(f) for f in CODEBOOK],
    )
    one = one.groupBy("item", "labeler").agg(*[F.min_by(f, F.when(F.col(f).isNotNull(), F.col("o"))).alias(f) for f in CODEBOOK])
    long = one.select("item", "labeler", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("v")) for f in CODEBOOK])).alias("x"))
    return long.select("item", "labeler", "x.field", "x.v").where("v is not null")


def contingency(votes: DataFrame) -> DataFrame:
    """(field, x, y, vx, vy, n): how often labeler x said vx where y said vy, x before y.

    The pairs of one item are pairs of its labelers, each of whom has one vote; they are counted where they arise, so
    what is shuffled is one row per task and cell.
    """
    item = votes.groupBy("item", "field").agg(F.array_sort(F.collect_list(F.struct("labeler", "v"))).alias("all")).where(F.size("all") > 1)
    first = item.select("field", "all", F.posexplode("all").alias("k", "x"))
    pair = first.select("field", "x", F.explode(F.slice("all", F.col("k") + 2, F.size("all"))).alias("y"))
    return pair.groupBy("field", F.col("x.labeler").alias("x"), F.col("y.labeler").alias("y"), F.col("x.v").alias("vx"), F.col("y.v").alias("vy")).agg(F.count("*").alias("n"))


def agreement_matrix(votes: DataFrame) -> DataFrame:
    """(field, i, j, a) of every ordered pair of labelers who share an item."""
    c = contingency(votes)
    said = lambda who, v: c.groupBy("field", "x", "y", F.col(v).alias("v")).agg(F.sum("n").alias(who))
    chance = said("nx", "vx").join(said("ny", "vy"), ["field", "x", "y", "v"]).groupBy("field", "x", "y").agg(F.sum(F.col("nx") * F.col("ny")).alias("c"))
    cell = c.groupBy("field", "x", "y").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("vx") == F.col("vy"), F.col("n")).otherwise(0)).alias("same")).join(chance, ["field", "x", "y"], "left")
    e = F.coalesce(F.col("c"), F.lit(0)) / (F.col("n") * F.col("n"))
    a = cell.select("field", "x", "y", ((F.col("same") - F.col("n") * e) / (F.col("n") * (1 - e) + SHRINK)).alias("a"))
    return a.select("field", F.col("x").alias("i"), F.col("y").alias("j"), "a").unionByName(a.select("field", F.col("y").alias("i"), F.col("x").alias("j"), "a"))


def leading_vector(matrix: DataFrame, steps: int = 6, rounds: int = 60) -> DataFrame:
    """(field, i, u): the leading eigenvector of each field's ``matrix`` (field, i, j, a), of length one.

    The diagonal is raised by an eighth of the largest sum of a row, so that no eigenvalue of the other sign is as large
    as the leading one and the iteration does not swing. ``steps`` steps make one job; ``rounds`` jobs without rest raise, they cut nothing.
    """
    row = matrix.groupBy("field", "i").agg(F.sum(F.abs("a")).alias("s"))
    shifted = written(matrix.unionByName(row.withColumn("j", F.col("i")).withColumn("a", F.max("s").over(W.partitionBy("field")) / 8).select("field", "i", "j", "a")))
    u = written(_unit(row.select("field", "i", F.lit(1.0).alias("u"))))
    for _ in range(rounds):
        x = u
        for _ in range(steps):
            x = shifted.join(x.select("field", F.col("i").alias("j"), "u"), ["field", "j"]).groupBy("field", "i").agg(F.sum(F.col("a") * F.col("u")).alias("u"))
        new = written(_unit(x).join(u.withColumnRenamed("u", "before"), ["field", "i"]))
        moved = new.agg(F.max(F.abs(F.col("u") - F.col("before")))).first()[0]
        u = new.select("field", "i", "u")
        if moved is None or moved < SETTLED:
            return u
    raise RuntimeError(f"the vector did not settle within {rounds * steps} steps")


def _unit(x: DataFrame) -> DataFrame:
    norm = F.sqrt(F.sum(F.col("u") * F.col("u")).over(W.partitionBy("field")))
    return x.select("field", "i", F.coalesce(F.col("u") / F.nullif(norm, F.lit(0.0)), F.lit(0.0)).alias("u"))


def spectral_weights(votes: DataFrame) -> DataFrame:
    """(labeler, field, weight, reliability, n_votes); weight in 0..1 with the largest of a field at 1.

    A labeler who shares no item with another has a reliability of 0.5; who agrees less than by chance has 0.
    """
    a = written(agreement_matrix(votes))
    u = leading_vector(a)
    cell = a.join(u, ["field", "i"]).join(u.select("field", F.col("i").alias("j"), F.col("u").alias("w")), ["field", "j"])
    fit = cell.groupBy("field").agg(F.sum(F.col("a") * F.col("u") * F.col("w")).alias("up"), F.sum(F.pow(F.col("u") * F.col("w"), 2)).alias("down"))
    scale = F.sqrt(F.greatest(F.lit(0.0), F.coalesce(F.col("up") / F.nullif(F.col("down"), F.lit(0.0)), F.lit(0.0))))
    r = u.join(fit.select("field", scale.alias("scale")), "field").select("field", F.col("i").alias("labeler"), F.greatest(F.lit(0.0), F.least(F.lit(0.98), F.col("u") * F.col("scale"))).alias("reliability"), F.greatest(F.lit(0.0), "u").alias("u"))
    n = votes.groupBy("labeler", "field").agg(F.count("*").alias("n_votes"))
    top = F.max("u").over(W.partitionBy("field"))
    both = n.join(r, ["labeler", "field"], "left").withColumn("weight", F.coalesce(F.col("u") / F.nullif(top, F.lit(0.0)), F.lit(0.5)))
    return both.select("labeler", "field", "weight", F.coalesce("reliability", F.lit(0.5)).alias("reliability"), "n_votes")


def weighted_vote(votes: DataFrame, weights: DataFrame) -> DataFrame:
    """(item, field, v, confidence): the word with most weight, at a tie the one that the codebook names first.

    A vote of a labeler of reliability r weighs ln(1 + k r / (1 - r)) over k words, and a ten-thousandth at least, so
    that an item which only guessers labelled has a label.
    """
    size = F.try_element_at(F.create_map(*[F.lit(x) for f, w in CODEBOOK.items() for x in (f, len(w))]), F.col("field"))
    w = weights.select("labeler", "field", F.greatest(F.lit(1e-4), F.log1p(size * F.col("reliability") / (1 - F.col("reliability")))).alias("w"))
    each = votes.join(w, ["labeler", "field"]).groupBy("item", "field").agg(*[F.sum(F.when(F.col("v") == c, F.col("w")).otherwise(0.0)).alias(f"s{c}") for c in range(K)])
    s = F.array(*[F.round(f"s{c}", 9) for c in range(K)])
    total = F.aggregate(s, F.lit(0.0), lambda x, y: x + F.exp(y - F.array_max(s)))
    return each.select("item", "field", (F.array_position(s, F.array_max(s)) - 1).cast("int").alias("v"), (1 / total).alias("confidence"))


def consensus(labels: DataFrame) -> DataFrame:
    """One row per item and field with at least one readable label: (item_key, label_field, label_value, confidence).

    Nulls, blanks and words that the codebook does not know are no votes; doubled rows are one; an empty table gives an
    empty result.
    """
    votes = written(votes_of(labels))
    words = F.create_map(*[x for f, w in CODEBOOK.items() for x in (F.lit(f), F.array(*map(F.lit, w)))])
    vote = weighted_vote(votes, spectral_weights(votes))
    return vote.select(F.col("item").alias("item_key"), F.col("field").alias("label_field"), F.element_at(F.try_element_at(words, F.col("field")), F.col("v") + 1).alias("label_value"), "confidence")


def reliability(labels: DataFrame) -> DataFrame:
    """(labeler, label_field, weight, accuracy, n_votes): the spectral weight, and the share of votes that the consensus bears out."""
    votes = written(votes_of(labels))
    weights = written(spectral_weights(votes))
    right = votes.join(weighted_vote(votes, weights).select("item", "field", F.col("v").alias("best")), ["item", "field"])
    hit = right.groupBy("labeler", "field").agg(F.avg((F.col("v") == F.col("best")).cast("double")).alias("accuracy"))
    return weights.join(hit, ["labeler", "field"]).select("labeler", F.col("field").alias("label_field"), "weight", "accuracy", "n_votes")


def agreement(labels: DataFrame) -> DataFrame:
    """(label_field, n_items, observed, expected, alpha): chance-corrected agreement over items with two votes or more (Krippendorff, nominal)."""
    votes = votes_of(labels)
    cell = votes.groupBy("item", "field", "v").agg(F.count("*").alias("n"))
    item = cell.groupBy("item", "field").agg(F.sum("n").alias("m"), F.sum(F.col("n") * (F.col("n") - 1)).alias("pairs")).where("m > 1")
    seen = item.groupBy("field").agg(F.count("*").alias("n_items"), F.sum("m").alias("votes"), F.sum(F.col("pairs") / (F.col("m") - 1)).alias("agree"))
    margin = cell.join(item.select("item", "field"), ["item", "field"]).groupBy("field", "v").agg(F.sum("n").alias("c")).groupBy("field").agg(F.sum(F.col("c") * (F.col("c") - 1)).alias("cc"))
    both = seen.join(margin, "field").select(
        F.col("field").alias("label_field"), "n_items", (F.col("agree") / F.col("votes")).alias("observed"), (F.col("cc") / (F.col("votes") * (F.col("votes") - 1))).alias("expected"))
    return both.withColumn("alpha", F.when(F.col("expected") < 1, (F.col("observed") - F.col("expected")) / (1 - F.col("expected"))))
