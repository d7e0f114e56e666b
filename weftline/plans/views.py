"""Views for people and tools: what calls were about, projections without private text, artifacts and their role, one piece with its neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weftline.operators import events as E
from weftline.operators import pieces
from weftline.operators import steps as S
from weftline.plans.sessions import _ACTION, _OUT, _WITH, session_outline, wall_rollup
from weftline.plans.work import _LINK, _OBJ, _PIECE, _Q
from weftline.sources.tables import table

# Path segments that name no subject, and commands whose second word belongs to them.
DULL = ("src", "lib", "app", "tmp", "home", "srv", "work", "components", "node_modules")
PAIRED = r"^(git|gh|npm|pnpm|npx|docker|kubectl|psql|curl)$"


def _events(spark: SparkSession, d: str) -> DataFrame:
    return E.chat_events(table(spark, d, "claude"))


def subject_of(target: Column) -> Column:
    """What a call is about: the folder of a file, or a command with its sub-command."""
    segs = F.filter(F.split(target, "/"), lambda x: (x != "") & ~x.isin(*DULL))
    path = F.coalesce(F.try_element_at(segs, F.lit(-2)), F.try_element_at(segs, F.lit(-1)))
    words = F.split(F.trim(target), r"\s+")
    first, second = F.element_at(words, 1), F.try_element_at(words, F.lit(2))
    command = F.when(first.rlike(PAIRED) & second.isNotNull() & ~second.startswith("-"), F.concat_ws(" ", first, second)).otherwise(F.substring(first, 1, 16))
    return F.when(target.rlike(pieces.FILE), path).otherwise(command)


def call_subjects(spark: SparkSession, d: str) -> DataFrame:
    """The three most frequent subjects of each session's calls; at a tie the one seen first."""
    c = _events(spark, d).where("kind = 'tool' and target <> ''").withColumn("subject", subject_of(F.col("target")))
    n = c.groupBy("session", "subject").agg(F.count("*").alias("n"), F.min("i").alias("first_i"))
    return n.withColumn("k", F.row_number().over(W.partitionBy("session").orderBy(F.desc("n"), "first_i"))).where("k <= 3").select("session", "subject", "n", F.col("k").cast("bigint").alias("k"))


def private_outlines(spark: SparkSession, d: str) -> DataFrame:
    """Outlines that may leave the machine: hashed session ids, moves cut to their first and last 200, no text."""
    o = session_outline(spark, d)
    cut = F.when(F.length("moves") > 400, F.concat(F.substring("moves", 1, 200), F.expr("right(moves, 200)"))).otherwise(F.col("moves"))
    return o.select(F.substring(F.sha2("session", 256), 1, 16).alias("id"), cut.alias("moves"), "n_calls")


def artifact_roles(spark: SparkSession, d: str) -> DataFrame:
    """Files that a piece edited: outputs if something was committed or shipped after the edit, otherwise intermediate."""
    p = pieces.with_piece(S.with_facts(_events(spark, d))).where("kind = 'tool'")
    ship = p.where(F.col("action").isin("commit", "ship", "deploy") & ~F.col("err")).groupBy("piece_id").agg(F.max("i").alias("ship_i"))
    edit = p.where((F.col("action") == "edit") & ~F.col("err") & (F.col("target") != "")).groupBy("piece_id", "target").agg(F.max("i").alias("edit_i"))
    return edit.join(ship, "piece_id", "left").select("piece_id", F.col("target").alias("file"), F.when(F.col("ship_i") > F.col("edit_i"), "output").otherwise("intermediate").alias("role"))


def piece_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Every linked piece with the pieces it is linked to, in either direction."""
    lk = pieces.links(pieces.objects(_events(spark, d)))
    both = lk.select(F.col("a").alias("piece_id"), F.col("b").alias("other"), "relationship", "confidence").unionByName(lk.select(F.col("b").alias("piece_id"), F.col("a").alias("other"), "relationship", "confidence"))
    return both


def headline(spark: SparkSession, d: str) -> DataFrame:
    """The one thing to say first: the wall that most sessions met, if at least three did."""
    return wall_rollup(spark, d).where("sessions >= 3").orderBy(F.desc("sessions"), F.desc("calls"), "sig").limit(1).select("sig", "sessions", "calls")


def old_files(spark: SparkSession, d: str, days: int = 23) -> DataFrame:
    """Files of the raw feeds that a retention of ``days`` would drop, against the newest file of their feed."""
    f = table(spark, d, "raw_records").select("feed", "file_name", "written_on").distinct()
    newest = f.groupBy("feed").agg(F.max("written_on").alias("newest"))
    return f.join(newest, "feed").where(F.datediff("newest", "written_on") > days).groupBy("feed").agg(F.count("*").alias("files"))


def open_questions(spark: SparkSession, d: str) -> DataFrame:
    """What a team has to name: areas that files were touched in, and pieces that no kind of work fits."""
    from weftline.plans.ledger import work_types

    o = pieces.objects(_events(spark, d)).where("type = 'file'").agg(F.count_distinct(F.regexp_extract("id", r"^src/([a-z0-9_-]+)/", 1)).alias("n")).select(F.lit("areas").alias("what"), "n")
    return o.unionByName(work_types(spark, d).where("work_type = 'other'").agg(F.count("*").alias("n")).select(F.lit("untyped_pieces").alias("what"), "n"))


NAMES = (call_subjects, private_outlines, artifact_roles, piece_neighbours, headline, old_files, open_questions)
QUERIES = {f.__name__: f for f in NAMES}

from weftline.plans.sessions import SQL as _SESSION_SQL  # noqa: E402
from weftline.plans.ledger import SQL as _WORK_SQL  # noqa: E402

_DULL = ", ".join(_Q(x) for x in DULL)
SQL = {
    "call_subjects": _WITH + f""", c AS (SELECT session, i, target, list_filter(string_split(target, '/'), lambda x: x <> '' AND NOT list_contains([{_DULL}], x)) AS sg, string_split_regex(trim(target), '\\s+') AS w FROM ev WHERE kind = 'tool' AND target <> ''),
        s AS (SELECT session, i, CASE WHEN regexp_matches(target, {_Q(pieces.FILE)}) THEN coalesce(sg[-2], sg[-1]) WHEN regexp_matches(w[1], '{PAIRED}') AND w[2] IS NOT NULL AND NOT starts_with(w[2], '-') THEN w[1] || ' ' || w[2] ELSE left(w[1], 16) END AS subject FROM c),
        n AS (SELECT session, subject, count(*) AS n, min(i) AS first_i FROM s GROUP BY ALL) SELECT session, subject, n, k FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY n DESC, first_i) AS k FROM n) WHERE k <= 3""",
    "private_outlines": _OUT + "SELECT left(sha256(session), 16) AS id, CASE WHEN length(moves) > 400 THEN left(moves, 200) || right(moves, 200) ELSE moves END AS moves, n_calls FROM outline",
    "artifact_roles": _PIECE + f", a AS (SELECT *, {_ACTION} AS action FROM pc WHERE kind = 'tool'), sh AS (SELECT piece_id, max(i) AS ship_i FROM a WHERE action IN ('commit', 'ship', 'deploy') AND NOT err GROUP BY 1), ed AS (SELECT piece_id, target, max(i) AS edit_i FROM a WHERE action = 'edit' AND NOT err AND target <> '' GROUP BY ALL) SELECT piece_id, target AS file, CASE WHEN ship_i > edit_i THEN 'output' ELSE 'intermediate' END AS role FROM ed LEFT JOIN sh USING (piece_id)",
    "piece_neighbours": _LINK + "SELECT a AS piece_id, b AS other, relationship, confidence FROM lk UNION ALL SELECT b, a, relationship, confidence FROM lk",
    "headline": f"SELECT sig, sessions, calls FROM ({_SESSION_SQL['wall_rollup']}) WHERE sessions >= 3 ORDER BY sessions DESC, calls DESC, sig LIMIT 1",
    "old_files": "WITH f AS (SELECT DISTINCT feed, file_name, written_on FROM raw_records), n AS (SELECT feed, max(written_on) AS newest FROM f GROUP BY feed) SELECT feed, count(*) AS files FROM f JOIN n USING (feed) WHERE date_diff('day', written_on, newest) > 23 GROUP BY feed",
    "open_questions": _OBJ + f"SELECT 'areas' AS what, count(DISTINCT regexp_extract(id, '^src/([a-z0-9_-]+)/', 1)) AS n FROM ob WHERE type = 'file' UNION ALL SELECT 'untyped_pieces', count(*) FROM ({_WORK_SQL['work_types']}) WHERE work_type = 'other'",
}

