"""Shared readings of chat records: plain session ids, roles, texts, and ordered chunks of hot sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.stage import written

# Spellings of the roles, after trimming and lower case.
PERSON = ("user", "human", "person")
AGENT = ("assistant", "ai", "model", "agent", "bot")
OTHER = ("system", "developer", "tool", "summary", "function")


def plain_session(c: Column) -> Column:
    """A session id in plain form (lower case, 8-4-4-4-12); null for null, blank and unreadable ids."""
    bare = F.regexp_extract(F.lower(c), r"([0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12})", 1)
    h = F.regexp_replace(bare, "-", "")
    plain = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    return F.when((F.length(h) == 32) & ~h.rlike("^(.)\\1*$"), plain)


def role_of(c: Column) -> Column:
    """``user``, ``assistant``, ``other`` (known, no speaker), or null for an unreadable role."""
    r = F.lower(F.trim(c))
    return F.when(r.isin(*PERSON), "user").when(r.isin(*AGENT), "assistant").when(r.isin(*OTHER), "other")


def has_text(content: Column) -> Column:
    """True where an array of content blocks holds a text block that is not blank."""
    filled = lambda b: F.coalesce((b["type"] == "text") & b["text"].rlike(r"[^\s\p{Z}]"), F.lit(False))
    return F.coalesce(F.exists(content, filled), F.lit(False))


def ordered_chunks(df: DataFrame, by: list[str], chunks: int | None = None, keep: bool = True) -> DataFrame:
    """``df`` cut by range of ``by`` into chunks of about equal size, each sorted by ``by``.

    A session of any size is cut over several chunks, so no task holds a whole hot session. ``df`` is read twice, to
    find the ranges and to cut, so it is written before; without ``keep`` it is taken to be cheap to read.
    """
    spark = df.sparkSession
    n = chunks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return (written(df) if keep else df).repartitionByRange(n, *by).sortWithinPartitions(*by)
