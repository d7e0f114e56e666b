import json

from pyspark.sql import functions as F

from weftline.operators.drift import Target, cast, changes, file_fields, ingest, name_likeness, pattern_of_text

T = Target(
    {"id": ("str", {"c": ("id", "uid")}), "n": ("num", {"c": ("a.n", "a.count")}), "ok": ("bool", {"c": ("ok",)}), "tags": ("arr", {"c": ("tags",)}), "role": ("str", {"c": ("data.role", "data.speaker")})},
    embedded={"c": "data"},
)
SCHEMA = "raw_id long, client string, feed string, file_name string, written_on date, line_no int, raw string, id string"


def table(spark, files, client="c", feed="f"):
    from datetime import date

    rows, k = [], 0
    for d, (name, lines) in enumerate(files):
        for line, raw in enumerate(lines):
            k += 1
            rows.append((k, client, feed, name, date(2026, 1, d + 1), line, raw if raw is None or isinstance(raw, str) else json.dumps(raw), "clash"))
    return spark.createDataFrame(rows, SCHEMA)


def report(spark, files):
    got = changes(file_fields(ingest(table(spark, files), T), T))
    return {tuple(r) for r in got.select("file_name", "change_kind", "field_path", "new_path").collect()}


def test_ingest_keeps_everything(spark):
    rec = {"id": 5, "a": {"n": "7.5", "extra": [1]}, "ok": "true", "tags": [1, {"x": 2}], "new": None, "data": json.dumps({"role": "user", "k": 1})}
    r = ingest(table(spark, [("a", [rec, None, "{broken", "[1]", "{}"])]), T).orderBy("raw_id").collect()
    assert (r[0]["id"], r[0]["n"], r[0]["ok"], json.loads(r[0]["tags"]), r[0]["role"]) == ("5", 7.5, True, [1, {"x": 2}], "user")
    assert json.loads(r[0]["rescued"]) == {"a": {"extra": [1]}, "new": None, "data": {"k": 1}}
    assert json.loads(r[0]["replayed"]) == {"id": ["id", "num"], "n": ["a.n", "str"], "ok": ["ok", "str"]}
    assert [x["readable"] for x in r] == [True, False, False, False, True]
    assert r[1]["rescued"] is None and json.loads(r[2]["rescued"]) == "{broken" and r[4]["rescued"] is None


def test_uncastable_and_unknown_client(spark):
    r = ingest(table(spark, [("a", [{"id": {"deep": 1}, "a": {"n": "x"}, "ok": "maybe"}])]), T).first()
    assert r["id"] is None and r["n"] is None and r["ok"] is None
    assert json.loads(r["rescued"]) == {"id": {"deep": 1}, "a": {"n": "x"}, "ok": "maybe"}
    r = ingest(table(spark, [("a", [{"id": "x"}])], client="other"), T).first()
    assert r["id"] is None and json.loads(r["rescued"]) == {"id": "x"}


def test_changes(spark):
    one = {"id": "a1", "type": "user", "a": {"n": 3}, "path": "/x/y", "data": json.dumps({"role": "user"})}
    two = {"uid": "a2", "type": "user", "a": {"n": 4}, "path": {"root": "/", "cwd": "y"}, "data": json.dumps({"speaker": "user", "hidden": False})}
    three = {"uid": "a3", "type": "user", "a": {"n": "4"}, "path": {"root": "/", "cwd": "y"}, "data": {"speaker": "user", "hidden": True}}
    assert report(spark, [("1", [one, one, None]), ("2", [two, "{"]), ("3", [three])]) == {
        ("2", "renamed", "id", "uid"), ("2", "retyped", "path", ""), ("2", "renamed", "data.role", "data.speaker"), ("2", "added", "data.hidden", ""),
        ("3", "retyped", "a.n", ""), ("3", "retyped", "data", ""),
    }


def test_no_change_without_cause(spark):
    a, b = {"id": "x", "v": None}, {"id": "y", "v": 1}
    assert report(spark, [("1", [a]), ("2", ["{broken", None]), ("3", [b]), ("4", [{"id": "z", "v": None}])]) == set()
    assert changes(file_fields(ingest(table(spark, []), T), T)).count() == 0


def test_files_without_a_day(spark):
    df = table(spark, [("1", [{"id": "x"}]), ("2", [{"id": "y", "n": 1}])]).withColumn("written_on", F.lit(None).cast("date"))
    assert [tuple(r)[1:4] for r in changes(file_fields(ingest(df, T), T)).collect()] == [("2", "added", "n")]


def test_flags_are_not_paired_by_value(spark):
    assert report(spark, [("1", [{"id": "x", "success": True}]), ("2", [{"id": "y", "truncated": True}])]) == {("2", "removed", "success", ""), ("2", "added", "truncated", "")}


def test_helpers():
    assert name_likeness("permissionMode", "permission_mode") == 1 and name_likeness("a.role", "a.speaker") == 1 and name_likeness("slug", "branch") == 0
    assert pattern_of_text("msg_1a4d6b26") == "msg_h" and pattern_of_text("/srv/work/x") == "/srv/*" and pattern_of_text("a b") == "text"
    assert cast("1e400", "num") is None and cast(True, "num") is None and cast(3, "str") == "3"


def test_casts_lose_nothing():
    from weftline.operators.drift import cast

    assert cast(2**53, "num") == float(2**53) and cast(2**53 + 1, "num") is None and cast(10**400, "num") is None and cast(1.5, "num") == 1.5
    assert cast("7", "num") == 7.0 and cast("007", "num") is None and cast("1.5", "num") == 1.5 and cast("1e3", "num") is None and cast("nan", "num") is None
