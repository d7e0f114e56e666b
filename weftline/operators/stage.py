"""Cutting lineage and spreading hot keys: what several operators need to stay whole and safe on a cluster."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

_OWN: dict[int, str] = {}
_MADE: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Where the session names none, a temporary folder is used, which is right only for a master on this machine; on a
    cluster without the setting this raises.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is unset: name a folder that all executors share")
    key = id(spark.sparkContext)
    if key not in _OWN:
        _OWN[key] = tempfile.mkdtemp(prefix="weftline-")
        atexit.register(shutil.rmtree, _OWN[key], True)
    return _OWN[key]


def _drop_made() -> None:
    """Deletes what this process left in the shared folder; what can't be deleted any more stays."""
    for spark, path in _MADE:
        drop_path(spark, path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a path of the shared folder; one that can't be deleted (any more) stays and stops no other."""
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  # the session may be gone
        pass


def shared_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder, deleted when this process ends: results that are read later than that have to be written elsewhere."""
    path = f"{shared_folder(spark)}/{name}"
    if not _MADE:
        atexit.register(_drop_made)
    _MADE.append((spark, path))
    return path


def written(df: DataFrame) -> DataFrame:
    """``df`` written once as a parquet table in the shared folder and read back: lineage is cut, a lost executor loses nothing."""
    spark = df.sparkSession
    path = shared_path(spark, f"t-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def salted_left_join(large: DataFrame, small: DataFrame, on: list[str], salts: int = 8) -> DataFrame:
    """Left join of ``large`` to the at most one row per key of ``small``; rows of one key are spread over ``salts`` tasks.

    Nothing is dropped for skew: ``small`` is repeated once per salt, so a key that holds a third of all rows is
    joined by ``salts`` tasks. Null keys never match and are spread by the salt, too.
    """
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in large.columns if c not in on] or [F.monotonically_increasing_id()]), F.lit(salts)).cast("int")
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return large.withColumn("_salt", salt).join(right, [*on, "_salt"], "left").drop("_salt")


def running(df: DataFrame, key: str, at: str, order: list[str], sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, before: bool = False, width: int = 50_000) -> DataFrame:
    """Running sums and running last non-null values per ``key``, in the order of ``order``, as new columns of ``df``.

    A key of any size is cut into stretches of ``width`` values of the whole number ``at``, which has to rise with the
    order; each stretch is one window, and what the stretches before it add up to is joined in from one small row per
    stretch. With ``before`` the row itself does not count.
    """
    sums, lasts = sums or {}, lasts or {}
    cut = df.withColumn("_cut", F.floor(F.col(at) / width))
    place = F.struct(*order)
    per = cut.groupBy(key, "_cut").agg(*[F.sum(c).alias(f"_s_{n}") for n, c in sums.items()], *[F.max_by(c, F.when(c.isNotNull(), place)).alias(f"_l_{n}") for n, c in lasts.items()])
    earlier = W.partitionBy(key).orderBy("_cut").rowsBetween(W.unboundedPreceding, -1)
    carry = per.select(key, "_cut", *[F.sum(f"_s_{n}").over(earlier).alias(f"_s_{n}") for n in sums], *[F.last(f"_l_{n}", ignorenulls=True).over(earlier).alias(f"_l_{n}") for n in lasts])
    w = W.partitionBy(key, "_cut").orderBy(*order).rowsBetween(W.unboundedPreceding, -1 if before else 0)
    own = cut.select("*", *[F.sum(c).over(w).alias(f"_o_{n}") for n, c in sums.items()], *[F.last(c, ignorenulls=True).over(w).alias(f"_o_{n}") for n, c in lasts.items()])
    joined = own.join(carry, [key, "_cut"], "left")
    return joined.select(
        *[F.col(c) for c in df.columns], *[(F.coalesce(F.col(f"_o_{n}"), F.lit(0)) + F.coalesce(F.col(f"_s_{n}"), F.lit(0))).alias(n) for n in sums], *[F.coalesce(F.col(f"_o_{n}"), F.col(f"_l_{n}")).alias(n) for n in lasts])


def missing(c: Column) -> Column:
    """True where a text is null or blank."""
    return c.isNull() | (F.trim(c) == "")
