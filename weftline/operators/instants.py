"""Mixed timestamp texts to instants in UTC.

Every known format is compiled into ONE anchored alternation with named groups. A single ``regexp_replace`` turns a text
into its components (year, month, ..., zone) in one pass of the matcher; the components are checked against the calendar
and assembled by integer day arithmetic (days since 1970 by the civil calendar, then milliseconds). Only wall times
without a zone need a zone table: they are read as the clock of the zone that the caller names.
"""

from __future__ import annotations

import re
import zoneinfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Formats. %Y year, %m month, %b month name, %d day, %H hour, %I hour of twelve, %M minute, %S second,
# %f fraction, %p half of the day, %z zone, %e epoch; everything else is a plain pattern.
FORMATS = (
    r"%Y-%m-%d[T ]%H:%M(?::%S(?:[.,]%f)?)? ?(?:%z)?",
    r"%Y%m%dT%H%M%S(?:[.,]%f)?(?:%z)?",
    r"%d\.%m\.%Y,? %H:%M(?::%S(?:[.,]%f)?)?(?: %z)?",
    r"%m/%d/%Y,? %I:%M(?::%S(?:[.,]%f)?)? ?%p",
    r"%m/%d/%Y,? %H:%M(?::%S(?:[.,]%f)?)?",
    r"(?:[A-Za-z]{3}, )?%d %b %Y %H:%M(?::%S)? %z",
    r"%e",
)

# Patterns of the parts.
PARTS = {
    "Y": r"[0-9]{4}",
    "m": r"[0-9]{1,2}",
    "d": r"[0-9]{1,2}",
    "b": r"[A-Za-z]{3}",
    "H": r"[0-9]{1,2}",
    "I": r"[0-9]{1,2}",
    "M": r"[0-9]{2}",
    "S": r"[0-9]{2}",
    "f": r"[0-9]{1,9}",
    "p": r"[AaPp]\.?[Mm]\.?",
    "z": r"[A-Za-z]{1,5}|[+-][0-9]{2}:?[0-9]{2}|[+-][0-9]{2}",
    "e": r"[0-9]{19}|[0-9]{16}|[0-9]{13}|[0-9]{10}",
}
#: In a format without separators months, days and hours have two digits.
NARROW = {"m": r"[0-9]{2}", "d": r"[0-9]{2}", "H": r"[0-9]{2}"}

# Minutes east of UTC of zone abbreviations.
ABBREVIATIONS = {
    "Z": 0,
    "UT": 0,
    "UTC": 0,
    "GMT": 0,
    "WET": 0,
    "BST": 60,
    "WEST": 60,
    "CET": 60,
    "CEST": 120,
    "EET": 120,
    "EEST": 180,
    "MSK": 180,
    "IST": 330,
    "JST": 540,
    "KST": 540,
    "AEST": 600,
    "AEDT": 660,
    "BRT": -180,
    "BRST": -120,
    "EDT": -240,
    "EST": -300,
    "CDT": -300,
    "CST": -360,
    "MDT": -360,
    "MST": -420,
    "PDT": -420,
    "PST": -480,
}
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

_SEP = "\x1f"
_ORDER = "YmbdHIMSfpze"
_DAY = 86_400_000


def compile_formats(formats: tuple[str, ...] = FORMATS) -> tuple[str, str]:
    """The one alternation over all formats, and the replacement that writes its components between separators."""
    names: dict[str, list[str]] = {k: [] for k in _ORDER}
    branches = []
    for i, f in enumerate(formats):
        tight = "%Y%m%d" in f

        def part(m: re.Match) -> str:
            k = m[1]
            names[k].append(name := f"{k}{i}" if k.islower() else f"{k}u{i}")
            return f"(?<{name}>{NARROW.get(k, PARTS[k]) if tight else PARTS[k]})"

        branches.append(re.sub("%([A-Za-z])", part, f))
    pattern = r"^\s*(?:" + "|".join(branches) + r")\s*$"
    return pattern, _SEP.join("".join(f"${{{n}}}" for n in names[k]) for k in _ORDER)


def civil_days(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a date of the civil calendar, by integer arithmetic."""
    yy = y - F.when(m <= 2, 1).otherwise(0)
    era = F.expr("1") * F.floor(yy / 400)
    yoe = yy - era * 400
    doy = F.floor((F.pmod(m + 9, F.lit(12)) * 153 + 2) / 5) + d - 1
    doe = yoe * 365 + F.floor(yoe / 4) - F.floor(yoe / 100) + doy
    return (era * 146_097 + doe - 719_468).cast("bigint")


def month_length(y: Column, m: Column) -> Column:
    leap = ((F.pmod(y, F.lit(4)) == 0) & (F.pmod(y, F.lit(100)) != 0)) | (F.pmod(y, F.lit(400)) == 0)
    return F.when(m == 2, F.when(leap, 29).otherwise(28)).otherwise(30 + F.pmod(m + F.floor(m / 8), F.lit(2)))


def usual_iso(c: Column) -> Column:
    """True where a text has the usual form of a log time, ``2026-01-31T09:05:07.250Z``."""
    return F.coalesce(c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]{3}Z$"), F.lit(False))


def usual_epoch(c: Column) -> Column:
    """True where a text has the usual form of a stored time, 13 digits."""
    return F.coalesce(c.rlike(r"^[0-9]{13}$"), F.lit(False))


def with_wall(df: DataFrame, text: str, out: str = "_t", formats: tuple[str, ...] = FORMATS) -> DataFrame:
    """Adds ``out``, a struct (wall_ms, offset_min, instant_ms) read from the column ``text``.

    ``instant_ms`` is set for epochs and for texts with a zone. ``wall_ms`` alone is set for a wall time without a
    zone. All three are null for null, empty and unreadable texts and for impossible dates or times (month 13,
    31 April, 29 February of a common year, hour 24, second 60, year 0).
    """
    pattern, replacement = compile_formats(formats)
    raw = F.col(text)
    parts = F.split(F.regexp_replace(raw, pattern, replacement), _SEP)
    n = len(_ORDER)
    df = df.withColumn("_p", F.when(raw.isNotNull() & ~F.contains(raw, F.lit(_SEP)), parts))
    ok = F.size("_p") == n
    get = {k: F.when(ok, F.nullif(F.element_at("_p", i + 1), F.lit(""))) for i, k in enumerate(_ORDER)}
    num = lambda k: get[k].try_cast("int")
    month_name = F.lower(get["b"])
    month = F.coalesce(num("m"), F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), month_name), F.lit(0)).cast("int"))
    afternoon = F.lower(F.substring(get["p"], 1, 1)) == "p"
    twelve = num("I")
    hour = F.coalesce(num("H"), F.when(twelve.between(1, 12), F.pmod(twelve, F.lit(12)) + F.when(afternoon, 12).otherwise(0)))
    ms = F.coalesce(F.rpad(F.substring(get["f"], 1, 3), 3, "0").try_cast("int"), F.lit(0))
    zone = F.upper(get["z"])
    table = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    digits = F.regexp_replace(zone, "[^0-9]", "")
    zh, zm = F.substring(digits, 1, 2).try_cast("int"), F.coalesce(F.nullif(F.substring(digits, 3, 2), F.lit("")).try_cast("int"), F.lit(0))
    signed = F.when((zh <= 18) & (zm <= 59), (zh * 60 + zm) * F.when(F.substring(zone, 1, 1) == "-", -1).otherwise(1))
    df = df.withColumn(
        "_q",
        F.struct(
            num("Y").alias("y"), month.alias("m"), num("d").alias("d"), hour.alias("h"), num("M").alias("i"),
            F.coalesce(num("S"), F.lit(0)).alias("s"), ms.alias("ms"), get["z"].isNotNull().alias("zoned"),
            F.when(zone.rlike("^[+-]"), signed).otherwise(F.try_element_at(table, zone)).alias("offset"), get["e"].alias("e"),
        ),
    )
    q = lambda k: F.col(f"_q.{k}")
    valid = (
        (q("y") >= 1) & q("m").between(1, 12) & (q("d") >= 1) & (q("d") <= month_length(q("y"), q("m")))
        & q("h").between(0, 23) & q("i").between(0, 59) & q("s").between(0, 59)
    )
    wall = F.when(valid, civil_days(q("y"), q("m"), q("d")) * _DAY + q("h") * 3_600_000 + q("i") * 60_000 + q("s") * 1000 + q("ms"))
    e, size = q("e").try_cast("bigint"), F.length(q("e"))
    epoch = F.when(size == 10, e * 1000).when(size == 13, e).when(size == 16, F.floor(e / F.lit(1000))).when(size == 19, F.expr("try_cast(_q.e as bigint) div 1000000"))
    df = df.withColumn("_wall", wall)
    readable = F.col("_wall").isNotNull() & (~q("zoned") | q("offset").isNotNull())
    offset = F.when(readable & q("zoned"), q("offset"))
    return df.withColumn(
        out,
        F.struct(
            F.when(readable, F.col("_wall")).alias("wall_ms"),
            offset.alias("offset_min"),
            F.coalesce(epoch, F.col("_wall") - offset * 60_000).alias("instant_ms"),
        ),
    ).drop("_p", "_q", "_wall")


def wall_to_utc(wall_ms: Column, zone: Column) -> Column:
    """Instant in ms of a wall time of a named zone: at a clock set back the first of the two, at one set forward the later clock."""
    return F.unix_millis(F.to_utc_timestamp(F.timestamp_millis(wall_ms), zone))


def known_zones(machines: DataFrame) -> DataFrame:
    """The rows of a (machine, zone_name) table that name a known zone; one per machine, the least name at a tie."""
    known = sorted(zoneinfo.available_timezones())
    return (
        machines.where(F.col("machine").isNotNull() & F.col("zone_name").isin(known))
        .groupBy("machine").agg(F.min("zone_name").alias("zone_name"))
    )


def to_instants(df: DataFrame, text: str, machines: DataFrame, machine: str = "machine", out: str = "utc_ms") -> DataFrame:
    """Adds ``out``, the instant in ms since 1970 UTC that the column ``text`` states; finer digits are cut off.

    A text without a zone is the wall time of the zone of ``machine`` in ``machines`` (machine, zone_name); without a
    known machine it states no instant. Null, empty, unreadable and impossible texts give null. ``machines`` is a
    small dimension, which Catalyst broadcasts if its file is below the session's threshold and joins by sort otherwise.
    Other columns stay as they are; helper names start with an underscore.
    """
    zones = known_zones(machines).select(F.col("machine").alias("_m"), F.col("zone_name").alias("_zone"))
    df = with_wall(df, text, "_t")
    df = df.join(zones, F.col(machine) == F.col("_m"), "left")
    value = F.coalesce(F.col("_t.instant_ms"), F.when(F.col("_t.offset_min").isNull(), wall_to_utc(F.col("_t.wall_ms"), F.col("_zone"))))
    return df.withColumn(out, value).drop("_t", "_m", "_zone")
