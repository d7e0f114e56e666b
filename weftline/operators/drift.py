"""Schemas that drift between files: ingestion with a rescue column, and a report of each change.

``ingest`` enforces a target schema. A field of the declared type goes to its typed column; what is unknown or of
another type stays as JSON in ``rescued``. Approved fields (``promoted``: later names of a target field) are replayed
from the rescued part into the typed column, cast where the value survives it. Typed columns and ``rescued`` hold
together what the record held; of a key that a line names twice, the last value counts, as JSON readers have it.

``file_fields`` reads off the ingested table which field had which JSON type in which file: typed columns stand for their
declared fields, ``replayed`` names those that came under another name or type, the rest is in ``rescued``. ``changes``
compares each file of a feed with the one before.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weftline.operators.stage import written

_SQL = {"str": "string", "num": "double", "bool": "boolean", "arr": "string"}


@dataclass(frozen=True)
class Target:
    """A target schema: ``columns`` maps a column to its type (str, num, bool, arr) and, by client, its paths.

    The first path of a client is the declared one, the others are promoted later names. ``embedded`` names fields
    whose text is read as an object of fields.
    """

    columns: dict[str, tuple[str, dict[str, tuple[str, ...]]]]
    embedded: dict[str, str] = field(default_factory=dict)

    def ddl(self) -> str:
        return ", ".join(f"{c} {_SQL[t]}" for c, (t, _) in self.columns.items())


def json_type(v: object) -> str | None:
    """str, num, bool, arr or obj; None for null, which is no type. All numbers are one type."""
    if v is None:
        return None
    if isinstance(v, bool):
        return "bool"
    if isinstance(v, (int, float)):
        return "num"
    return {str: "str", list: "arr", dict: "obj"}[type(v)]


def cast(v: object, kind: str) -> object:
    """``v`` as a value of ``kind``, or None where it states none or would lose something: a whole number that no double
    holds, or a text such as ``007`` that its number would not be written as, is left to be rescued."""
    t = json_type(v)
    if t == kind:
        if kind == "num":
            try:
                return float(v) if float(v) == v else None
            except OverflowError:
                return None
        return json.dumps(v, ensure_ascii=False) if kind == "arr" else v
    if kind == "str" and t in ("num", "bool"):
        return json.dumps(v)
    if kind == "num" and t == "str":
        try:
            x = float(v)
            return x if math.isfinite(x) and v in (repr(x), repr(int(x)) if x.is_integer() else "") else None
        except ValueError:
            return None
    if kind == "bool" and t == "str":
        return {"true": True, "false": False}.get(v.strip().lower())
    return None


def read_record(raw: str | None, embedded: str | None) -> tuple[dict | None, str | None]:
    """The record and the type that its embedded field had; (None, None) for null, broken and non-object lines."""
    if raw is None:
        return None, None
    try:
        o = json.loads(raw)
    except (ValueError, RecursionError):
        return None, None
    if not isinstance(o, dict):
        return None, None
    form = None
    if embedded and embedded in o:
        form = json_type(o[embedded])
        if form == "str":
            try:
                inner = json.loads(o[embedded])
                if isinstance(inner, dict):
                    o = o | {embedded: inner}
            except (ValueError, RecursionError):
                pass
    return o, form


@lru_cache(200_000)
def pattern_of_text(v: str) -> str:
    """What a text looks like: words as they are, digits and hex ids as classes, paths by their first part."""
    if re.search(r"\s", v) or len(v) > 80:
        return "text"
    s = re.sub(r"(?<![0-9a-zA-Z])(?=[a-f]*[0-9])[0-9a-fA-F]{6,}(?![0-9a-zA-Z])", "h", v.lower())
    s = re.sub(r"\d+", "9", s)
    if "/" in s:
        at = s.index("/", 1) if "/" in s[1:] else len(s)
        return s[:at] + "/*"
    return s if len(s) <= 40 else "word"


def pattern_of(v: object, kind: str | None) -> str:
    if kind == "str":
        return pattern_of_text(v)
    if kind == "num":
        if isinstance(v, int):
            return f"n{len(str(abs(v)))}"
        return f"f{math.floor(math.log10(abs(v))) if v and math.isfinite(v) else 0}"
    if kind == "bool":
        return str(v).lower()
    if kind == "obj":
        return ",".join(sorted(v))[:200]
    return kind or ""


def rest_fields(o: dict, prefix: str = "") -> Iterator[tuple[str, object]]:
    """(path, value) of every field of what was rescued, objects before what they hold."""
    for k, v in o.items():
        yield prefix + k, v
        if isinstance(v, dict):
            yield from rest_fields(v, prefix + k + ".")


def _take(o: dict, path: str) -> tuple[bool, object]:
    for k in path.split("."):
        if not isinstance(o, dict) or k not in o:
            return False, None
        o = o[k]
    return True, o


def _drop(o: dict, path: str) -> None:
    keys = path.split(".")
    chain = [o]
    for k in keys[:-1]:
        chain.append(chain[-1][k])
    del chain[-1][keys[-1]]
    for d, k in zip(reversed(chain[:-1]), reversed(keys[:-1])):
        if d[k]:
            break
        del d[k]


def enforce(o: dict, client: str, form: str | None, target: Target) -> tuple[list, str | None, str | None]:
    """The typed values of a record in column order, the rest as JSON, and what was replayed; ``o`` is used up.

    ``replayed`` is JSON: by column the path and the type it had, where either is not the declared one, and under ''
    the type of the embedded field where it is no text. The last two are null where there is nothing to say.
    """
    values: list = []
    replayed: dict = {}
    for column, (kind, paths) in target.columns.items():
        value = None
        for i, path in enumerate(paths.get(client, ())):
            there, v = _take(o, path)
            if not there or (got := cast(v, kind)) is None:
                continue
            value = got
            _drop(o, path)
            if i or json_type(v) != kind:
                replayed[column] = [path, json_type(v)]
            break
        values.append(value)
    if form not in (None, "str"):
        replayed[""] = form
    return values, json.dumps(o, ensure_ascii=False, sort_keys=True) if o else None, json.dumps(replayed) if replayed else None


def ingest(records: DataFrame, target: Target) -> DataFrame:
    """One row per line of ``records`` (raw_id, client, feed, file_name, written_on, line_no, raw): the keys, ``readable``, the typed columns, ``rescued``, ``replayed``.

    A null or broken line, and a line that is no object, is not readable: its typed columns are null and ``rescued``
    holds the line as a JSON text. Doubled lines stay as many as they are. An unknown client has no declared fields: all
    of its record is rescued. Extra columns of ``records`` are left out.
    """
    keys = ["raw_id", "client", "feed", "file_name", "written_on", "line_no"]
    names = list(target.columns)

    def kernel(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            typed, readable, rescued, replayed = [], [], [], []
            for client, raw in zip(pdf["client"].array, pdf["raw"].array):
                o, form = read_record(raw, target.embedded.get(client))
                readable.append(o is not None)
                if o is None:
                    values, rest, again = [None] * len(names), None if raw is None else json.dumps(raw, ensure_ascii=False), None
                else:
                    values, rest, again = enforce(o, client, form, target)
                typed.append(values)
                rescued.append(rest)
                replayed.append(again)
            out = pdf[keys].reset_index(drop=True)
            out["readable"] = readable
            for i, n in enumerate(names):
                out[n] = pd.Series([r[i] for r in typed], dtype=object)
            out["rescued"] = pd.Series(rescued, dtype=object)
            out["replayed"] = pd.Series(replayed, dtype=object)
            yield out

    cols = records.select("raw_id", "client", "feed", "file_name", F.col("written_on").cast("string"), "line_no", "raw")
    return cols.mapInPandas(kernel, f"raw_id bigint, client string, feed string, file_name string, written_on string, line_no int, readable boolean, {target.ddl()}, rescued string, replayed string")


def file_fields(ingested: DataFrame, target: Target) -> DataFrame:
    """(feed, written_on, file_name, path, type, pattern, n) over the readable lines of an ingested table: what each file holds.

    Counts are added up in the batch before they are shuffled, so a feed with a third of all lines sends few rows.
    """
    names = list(target.columns)

    def kernel(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seen: Counter = Counter()
            typed = [pdf[n].array for n in names]
            for row, (client, feed, day, name, rest, again) in enumerate(zip(*(pdf[c].array for c in ("client", "feed", "written_on", "file_name", "rescued", "replayed")))):
                embedded = target.embedded.get(client)
                moved = json.loads(again) if again else {}
                held: dict[str, tuple[str, str]] = {}
                children: dict[str, set[str]] = {}
                for column, values in zip(names, typed):
                    v = values[row]
                    if v is None or v is pd.NA or v != v:
                        continue
                    kind, paths = target.columns[column]
                    path, was = moved.get(column) or (paths[client][0], kind)
                    held[path] = (was, "arr" if kind == "arr" else pattern_of(int(v) if kind == "num" and float(v).is_integer() else v, kind))
                for path, v in rest_fields(json.loads(rest)) if rest else ():
                    if isinstance(v, dict):
                        children.setdefault(path, set())
                    else:
                        held[path] = (json_type(v) or "", pattern_of(v, json_type(v)))
                for path in list(held):
                    while "." in path:
                        path, _, leaf = path.rpartition(".")
                        children.setdefault(path, set()).add(leaf)
                for path, leaves in children.items():
                    held[path] = (moved.get("", "str") if path == embedded else "obj", ",".join(sorted(leaves)))
                for path, (kind, pattern) in held.items():
                    seen[(feed, day, name, path, kind, pattern)] += 1
            yield pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["feed", "written_on", "file_name", "path", "type", "pattern", "n"])

    cols = ingested.where(F.col("readable") & F.col("feed").isNotNull() & F.col("file_name").isNotNull())
    cols = cols.select("client", "feed", F.coalesce("written_on", F.lit("")).alias("written_on"), "file_name", *names, "rescued", "replayed")
    out = cols.mapInPandas(kernel, "feed string, written_on string, file_name string, path string, type string, pattern string, n bigint")
    return out.groupBy("feed", "written_on", "file_name", "path", "type", "pattern").agg(F.sum("n").alias("n"))


# Words that name the same thing in field names.
SAME_MEANING = (
    ("timestamp", "time", "ts", "at", "created"),
    ("type", "kind"),
    ("uuid", "id", "recordid"),
    ("role", "speaker", "author"),
    ("finish", "stop"),
    ("cwd", "workdir", "path", "directory", "dir"),
    ("input", "prompt"),
    ("output", "completion", "result"),
    ("arguments", "args", "input"),
    ("agent", "mode"),
    ("model", "modelid"),
    ("thread", "session"),
    ("branch", "gitbranch"),
)


def _words(path: str) -> set[str]:
    name = path.rpartition(".")[2]
    name = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name)
    return {w for w in re.split(r"[^a-z0-9]+", name.lower()) if w}


def name_likeness(a: str, b: str) -> float:
    """0 to 1: how much two field names say the same, by their words and by words of one meaning."""
    x, y = _words(a), _words(b)
    if not x or not y:
        return 0.0
    if "".join(sorted(x)) == "".join(sorted(y)) or x == y:
        return 1.0
    same = sum(any(p == q or any(p in g and q in g for g in SAME_MEANING) for q in y) for p in x)
    back = sum(any(p == q or any(p in g and q in g for g in SAME_MEANING) for p in x) for q in y)
    return (same / len(x) + back / len(y)) / 2


def changes(fields: DataFrame, least: float = 0.5) -> DataFrame:
    """(feed, file_name, change_kind, field_path, new_path): each change from one file of a feed to the next.

    Files follow each other by ``written_on`` (those without a day first), then name; files without a readable line have no fields and are passed
    over. A field that vanishes and one of the same parent and type that appears are one renamed field if their values
    look alike (shared share of value patterns of at least ``least``) or their names do, each being the best partner of
    the other; two flags need names that are alike. Below a retyped or renamed field nothing is reported.
    """
    fields = written(fields)
    files = fields.select("feed", "written_on", "file_name").distinct()
    order = W.partitionBy("feed").orderBy("written_on", "file_name")
    files = files.withColumn("no", F.row_number().over(order)).withColumn("last", F.count("*").over(W.partitionBy("feed")))
    per = fields.groupBy("feed", "written_on", "file_name", "path").agg(F.array_sort(F.collect_set(F.nullif("type", F.lit("")))).alias("types"))
    per = per.join(files, ["feed", "written_on", "file_name"]).drop("written_on", "file_name")
    w = W.partitionBy("feed", "path").orderBy("no")
    seq = per.withColumn("prev", F.lag("no").over(w)).withColumn("next", F.lead("no").over(w))
    new = F.coalesce(F.col("prev") != F.col("no") - 1, F.lit(True))
    seq = seq.withColumn("stretch", F.sum(F.when(new, 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    known = F.when(F.size("types") > 0, F.col("types"))
    before = F.last(known, ignorenulls=True).over(W.partitionBy("feed", "path", "stretch").orderBy("no").rowsBetween(W.unboundedPreceding, -1))
    seq = written(seq.withColumn("was", before).withColumn("new", new))
    retyped = seq.where(~F.col("new") & (F.size("types") > 0) & F.col("was").isNotNull() & (F.col("was") != F.col("types"))).select("feed", "no", "path")
    added = seq.where(F.col("new") & (F.col("no") > 1)).select("feed", "no", "path", "types", F.col("no").alias("in_file"))
    removed = seq.where((F.col("no") < F.col("last")) & F.coalesce(F.col("next") != F.col("no") + 1, F.lit(True))).select("feed", (F.col("no") + 1).alias("no"), "path", F.coalesce(known, F.col("was")).alias("types"), F.col("no").alias("in_file"))
    parent = F.when(F.contains("path", F.lit(".")), F.regexp_replace("path", r"\.[^.]*$", "")).otherwise("")
    a = added.select("feed", "no", parent.alias("parent"), F.col("path").alias("new_path"), F.col("types").alias("new_types"))
    r = removed.select("feed", "no", parent.alias("parent"), "path", "types")
    pair = written(r.join(a, ["feed", "no", "parent"]).where(F.coalesce((F.size("types") > 0) & (F.col("types") == F.col("new_types")), F.lit(False))))
    # The patterns of the fields in question only, as shares of the field's values in its file.
    numbered = fields.where("type <> ''").join(files, ["feed", "written_on", "file_name"])
    asked = pair.select("feed", (F.col("no") - 1).alias("no"), "path").unionByName(pair.select("feed", "no", F.col("new_path").alias("path"))).distinct()
    shares = numbered.join(asked, ["feed", "no", "path"]).groupBy("feed", "no", "path", "pattern").agg(F.sum("n").alias("n"))
    shares = written(shares.join(shares.groupBy("feed", "no", "path").agg(F.sum("n").alias("all")), ["feed", "no", "path"]).withColumn("p", F.col("n") / F.col("all")))
    left = shares.select("feed", (F.col("no") + 1).alias("no"), "path", "pattern", "p")
    right = shares.select("feed", "no", F.col("path").alias("new_path"), "pattern", F.col("p").alias("q"))
    alike = pair.select("feed", "no", "path", "new_path").join(left, ["feed", "no", "path"]).join(right, ["feed", "no", "new_path", "pattern"]).groupBy("feed", "no", "path", "new_path").agg(F.sum(F.least("p", "q")).alias("alike"))

    @F.pandas_udf("double")
    def named(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([name_likeness(p, q) for p, q in zip(x, y)], dtype=float)

    scored = pair.join(alike, ["feed", "no", "path", "new_path"], "left").withColumn("alike", F.coalesce("alike", F.lit(0.0))).withColumn("named", named("path", "new_path"))
    flag = F.array_contains("types", "bool")
    fits = F.when(flag, F.col("named") >= 0.5).otherwise((F.col("alike") >= least) | (F.col("named") >= 0.5))
    scored = scored.where(fits).withColumn("score", F.col("alike") + 1.2 * F.col("named"))
    by = lambda c, o: W.partitionBy("feed", "no", c).orderBy(F.desc("score"), o)
    best = scored.withColumn("i", F.row_number().over(by("path", "new_path"))).withColumn("j", F.row_number().over(by("new_path", "path")))
    renamed = written(best.where("i = 1 and j = 1").select("feed", "no", "path", "new_path"))
    gone = removed.join(renamed, ["feed", "no", "path"], "left_anti").select("feed", "no", F.lit("removed").alias("change_kind"), "path", F.lit("").alias("new_path"))
    come = added.join(renamed.select("feed", "no", F.col("new_path").alias("path")), ["feed", "no", "path"], "left_anti").select("feed", "no", F.lit("added").alias("change_kind"), "path", F.lit("").alias("new_path"))
    moved = renamed.select("feed", "no", F.lit("renamed").alias("change_kind"), "path", "new_path")
    other = retyped.select("feed", "no", F.lit("retyped").alias("change_kind"), "path", F.lit("").alias("new_path"))
    all_ = gone.unionByName(come).unionByName(moved).unionByName(other)
    # Ancestors of each path; one that is retyped or renamed in the same file covers what is below it.
    steps = F.split("path", r"\.")
    ups = F.transform(F.sequence(F.lit(1), F.size(steps) - 1), lambda k: F.array_join(F.slice(steps, 1, k), "."))
    below = all_.where(F.size(steps) > 1).select("feed", "no", "path", "change_kind", F.explode(ups).alias("up"))
    cover = retyped.select("feed", "no", F.col("path").alias("up")).unionByName(renamed.select("feed", "no", F.col("path").alias("up"))).unionByName(renamed.select("feed", "no", F.col("new_path").alias("up")))
    hidden = below.join(cover, ["feed", "no", "up"]).select("feed", "no", "path", "change_kind").distinct()
    shown = all_.join(hidden, ["feed", "no", "path", "change_kind"], "left_anti")
    return shown.join(files.select("feed", "no", "file_name"), ["feed", "no"]).select("feed", "file_name", "change_kind", F.col("path").alias("field_path"), "new_path")
