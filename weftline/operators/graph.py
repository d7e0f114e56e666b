"""Connected components by min-label propagation with pointer shortcuts; each round is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.stage import salted_left_join, written


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b); a component is named by its least node.

    A hot node's edges are spread by salts. The loop ends when no label changes; ``rounds`` raises and cuts nothing.
    """
    flip = links.select(F.col("b").alias("node"), F.col("a").alias("other"))
    edges = written(links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(flip).where("node <> other").distinct())
    labels = written(edges.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("component")))
    for _ in range(rounds):
        near = salted_left_join(edges, labels.select(F.col("node").alias("other"), F.col("component").alias("near")), ["other"])
        step = labels.join(near.groupBy("node").agg(F.min("near").alias("near")), "node").select("node", "component", F.least("component", "near").alias("next"))
        far = labels.select(F.col("node").alias("next"), F.col("component").alias("far"))
        new = written(salted_left_join(step, far, ["next"]).select("node", "component", F.least("next", F.coalesce("far", "next")).alias("new")))
        labels = new.select("node", F.col("new").alias("component"))
        if new.where("new <> component").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle within {rounds} rounds")
