"""Comparisons and evaluation: seeded bootstrap, medians, abstain curves, packing, sampling."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# The linear congruential generator that seeded resampling uses.
LCG_A, LCG_C, LCG_M = 1664525, 1013904223, 1 << 32


def lcg(seed: int, n: int) -> np.ndarray:
    """``n`` numbers of 0..1 of the generator, by jumps in powers of two instead of a loop."""
    mult, add = np.empty(n, dtype=np.uint64), np.empty(n, dtype=np.uint64)
    if n:
        mult[0], add[0] = LCG_A, LCG_C
    done = 1
    while done < n:
        k = min(done, n - done)
        a, c = int(mult[done - 1]), int(add[done - 1])
        mult[done : done + k] = (mult[:k] * np.uint64(a)) % np.uint64(LCG_M)
        add[done : done + k] = (mult[:k] * np.uint64(c) + add[:k]) % np.uint64(LCG_M)
        done += k
    return ((mult * np.uint64(seed) + add) % np.uint64(LCG_M)).astype(np.float64) / LCG_M


def bootstrap(before: np.ndarray, after: np.ndarray, resamples: int = 2000, seed: int = 7) -> tuple[float, float, float]:
    """(difference of means, lower, upper) of after - before: the interval holds 95 % of the resampled differences."""
    nb, na = len(before), len(after)
    u = lcg(seed, resamples * (nb + na)).reshape(resamples, nb + na)
    diff = after[(u[:, nb:] * na).astype(int)].mean(1) - before[(u[:, :nb] * nb).astype(int)].mean(1)
    diff.sort()
    return float(after.mean() - before.mean()), float(diff[resamples // 40]), float(diff[resamples - resamples // 40])


def compare_groups(values: DataFrame, least: int = 5) -> DataFrame:
    """Before and after by group, of rows (grp, after, value): means, bounds, and whether the difference is detectable.

    Values of a group are gathered in one task: pre-aggregate to one value per unit first. Groups with fewer than
    ``least`` values on a side have no row; null values are left out.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        b = np.sort(pdf.loc[~pdf["after"], "value"].to_numpy(float))
        a = np.sort(pdf.loc[pdf["after"], "value"].to_numpy(float))
        if len(b) < least or len(a) < least:
            return pd.DataFrame([], columns=["grp", "n_before", "n_after", "before_mean", "after_mean", "diff", "lo", "hi", "detectable"])
        d, lo, hi = bootstrap(b, a)
        return pd.DataFrame([(pdf["grp"].iloc[0], len(b), len(a), b.mean(), a.mean(), d, lo, hi, lo > 0 or hi < 0)], columns=["grp", "n_before", "n_after", "before_mean", "after_mean", "diff", "lo", "hi", "detectable"])

    return values.where("value is not null").groupBy("grp").applyInPandas(one, "grp string, n_before bigint, n_after bigint, before_mean double, after_mean double, diff double, lo double, hi double, detectable boolean")


def upper_median(c: Column) -> Column:
    """The element at floor(n / 2) of the sorted values."""
    s = F.array_sort(F.collect_list(c))
    return F.try_element_at(s, (F.floor(F.size(s) / 2) + 1).cast("int"))


def hash_split(key: Column, salt: str, share: float) -> Column:
    """'test' for the keys whose hash falls in the first ``share`` of its range, otherwise 'dev'."""
    h = F.conv(F.substring(F.sha2(F.concat_ws("|", key, F.lit(salt)), 256), 1, 8), 16, 10).cast("bigint")
    return F.when(h / F.lit(4294967296.0) < share, "test").otherwise("dev")


def round_robin(df: DataFrame, key: str, stratum: str, n: int, seed: int = 11) -> DataFrame:
    """``n`` rows, taken in turn from the strata: the k-th row of each before any stratum's next. Order in a stratum is by seeded hash."""
    w = W.partitionBy(stratum).orderBy(F.sha2(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))), 256), key)
    return df.withColumn("turn", F.row_number().over(w)).orderBy("turn", stratum).limit(n)


def abstain_curve(df: DataFrame) -> DataFrame:
    """(conf, answered, right_n, coverage, accuracy) for every threshold, of rows (conf, ok); counted per distinct value first."""
    per = df.groupBy("conf").agg(F.count("*").alias("n"), F.count_if("ok").alias("r"))
    w = W.orderBy(F.desc("conf")).rowsBetween(W.unboundedPreceding, 0)
    cum = per.select("conf", F.sum("n").over(w).alias("answered"), F.sum("r").over(w).alias("right_n"), F.sum("n").over(W.partitionBy(F.lit(0))).alias("all"))
    return cum.select("conf", "answered", "right_n", (F.col("answered") / F.col("all")).alias("coverage"), (F.col("right_n") / F.col("answered")).alias("accuracy"))


def fnv1a(c: Column) -> Column:
    """32-bit FNV-1a of an ASCII text, as a bigint, by a fold over its characters."""
    codes = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x).cast("bigint"))
    return F.aggregate(codes, F.lit(2166136261).cast("bigint"), lambda h, x: ((h.bitwiseXOR(x)) * F.lit(16777619)).bitwiseAND(F.lit(4294967295)))


def tree_score(trees: list[dict], rate: float = 0.1, init: float = 0.0) -> Column:
    """Probability by boosted trees {feature, threshold, left, right, value}, compiled to nested CASE expressions."""

    def node(t: dict, i: int) -> Column:
        if t["left"][i] < 0:
            return F.lit(float(t["value"][i]))
        return F.when(F.col(t["feature"][i]) <= t["threshold"][i], node(t, t["left"][i])).otherwise(node(t, t["right"][i]))

    z = F.lit(float(init))
    for t in trees:
        z = z + rate * node(t, 0)
    return 1 / (1 + F.exp(-z))


def pack_lanes(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Interval partitioning over a stream sorted by (grp, a): each interval goes to the first lane that is free before it."""
    grp, ends = None, []
    for pdf in batches:
        lanes = []
        for g, a, b in zip(pdf["grp"].array, pdf["a"].array, pdf["b"].array):
            if g != grp:
                grp, ends = g, []
            for k, end in enumerate(ends):
                if end < a:
                    ends[k] = b
                    break
            else:
                k = len(ends)
                ends.append(b)
            lanes.append(k)
        yield pdf.assign(lane=pd.Series(lanes, dtype="int64"))


def pack_bins(batches: Iterable[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    """Greedy bins over a stream sorted by grp: a bin closes before its size would pass ``most``."""
    grp, bin_, held = None, 0, 0
    for pdf in batches:
        bins = []
        for g, size in zip(pdf["grp"].array, pdf["size"].array):
            if g != grp:
                grp, bin_, held = g, 0, 0
            if held and held + size > most:
                bin_, held = bin_ + 1, 0
            held += size
            bins.append(bin_)
        yield pdf.assign(bin=pd.Series(bins, dtype="int64"))
