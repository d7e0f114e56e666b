"""Queries over the ledger of pieces: outcomes, changes of course, criteria, verification, kinds of work, filters and search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.rules import first_rule_sql
from weftline.functions.text import tokens
from weftline.operators import events as E
from weftline.operators import ledger as L
from weftline.operators import pieces
from weftline.operators import steps as S
from weftline.operators import threads as T
from weftline.operators import worktypes as WT
from weftline.operators.stage import written
from weftline.plans.sessions import _ACTION, _JUDGED, _RESULT
from weftline.plans.work import _PIECE, _Q, _TOK
from weftline.sources.tables import table


def _steps(spark: SparkSession, d: str) -> DataFrame:
    return L.piece_steps(E.chat_events(table(spark, d, "claude")))


def _asks(spark: SparkSession, d: str) -> DataFrame:
    return pieces.pieces(E.chat_events(table(spark, d, "claude"))).where("ask is not null").select("piece_id", "ask")


def piece_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """How every piece ended, by the cascade over its steps."""
    return T.goal_outcomes(_steps(spark, d)).withColumnRenamed("root", "piece")


def piece_backtracks(spark: SparkSession, d: str) -> DataFrame:
    """Changes of course of every piece with what triggered them."""
    return T.backtracks(_steps(spark, d)).withColumnRenamed("root", "piece")


def criteria(spark: SparkSession, d: str) -> DataFrame:
    """What every ask says that has to be true in the end."""
    return L.criteria(_asks(spark, d))


def constraints(spark: SparkSession, d: str) -> DataFrame:
    """What asks forbid or limit."""
    return L.constraints(_asks(spark, d))


def criteria_checked(spark: SparkSession, d: str) -> DataFrame:
    """Each criterion met, unmet or unknown."""
    steps = written(_steps(spark, d))
    asks = steps.where(pieces.opens_piece()).groupBy("piece_id").agg(F.min_by("text", "i").alias("ask"))
    return L.checked_criteria(steps, L.criteria(asks))


def verification_rollup(spark: SparkSession, d: str) -> DataFrame:
    return L.verification(_steps(spark, d))


def typed(steps: DataFrame) -> DataFrame:
    """The kind of work of every piece of ``steps``."""
    tool = F.col("kind") == "tool"
    share = lambda *a: F.coalesce(F.count_if(tool & F.col("action").isin(*a)) / F.greatest(F.lit(1), F.count_if(tool)), F.lit(0.0))
    last = F.max(F.when(tool & F.col("action").isin("commit", "ship", "deploy") & ~F.col("err"), F.col("i")))
    rows = steps.groupBy("piece_id").agg(
        F.min_by("text", F.when(pieces.opens_piece(), F.col("i"))).alias("ask"), F.count_if(tool).alias("n"), share("edit").alias("edits"), share("read", "search", "git_read").alias("reads"), share("commit", "ship", "deploy").alias("ships"), share("web").alias("web"),
        last.alias("ship_i"), *[F.min(F.when(tool & (F.col("action") == "edit") & ~F.col("err") & F.col("target").rlike(p), F.col("i"))).alias(n) for n, p in (("prose_i", r"\.(md|mdx|txt|docx)$"), ("visual_i", r"\.(css|scss|svg|png|jpg|mp4|tsx)$"))],
    ).where("ask is not null")
    put = lambda c: F.coalesce(F.col("ship_i") > F.col(c), F.lit(False))
    return WT.classify(rows.withColumn("prose", put("prose_i")).withColumn("visual", put("visual_i")))


def work_types(spark: SparkSession, d: str) -> DataFrame:
    """The kind of work of every piece, how sure it is, and the runner-up."""
    return typed(_steps(spark, d))


def _ledger(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    steps = written(_steps(spark, d))
    asks = steps.where(pieces.opens_piece()).groupBy("piece_id").agg(F.min_by("text", "i").alias("ask"))
    stated = L.criteria(asks)
    types = typed(steps).select("piece_id", "work_type")
    return L.ledger(steps, L.sessions(table(spark, d, "claude")), L.checked_criteria(steps, stated), types), steps, stated


def session_facts(spark: SparkSession, d: str) -> DataFrame:
    """Repository, permission mode, model, vendor and authority of every session."""
    return L.sessions(table(spark, d, "claude"))


def filter_ledger(spark: SparkSession, d: str, query: str = "outcome:succ conf:>=0.6 calls:>2") -> DataFrame:
    """Pieces that pass the filters of a query; its text part does not count here."""
    filters, _ = pieces.parse_query(query)
    return pieces.where_query(_ledger(spark, d)[0], filters).select("piece_id", "outcome", "success", "confidence", "verification", "work_type", "n_calls", "repo")


def search_ledger(spark: SparkSession, d: str, query: str = "nightly export webhook verification:unverified", limit: int = 20) -> DataFrame:
    """The pieces that answer a query best, with the number of all that match; score first, then the newest."""
    filters, text = pieces.parse_query(query)
    rows, steps, stated = _ledger(spark, d)
    rows = written(rows)
    doc = lambda df, f, c: df.select(F.col("piece_id").alias("doc"), F.lit(f).alias("field"), c.alias("text"))
    fields = doc(rows, "summary", F.col("title")).unionByName(doc(rows, "objective", F.col("ask"))).unionByName(doc(rows, "outcome", F.regexp_replace("outcome", "_", " "))).unionByName(doc(stated, "criteria", F.regexp_replace("criterion", "_", " ")))
    fields = fields.unionByName(doc(rows, "artifacts", F.array_join("files", " "))).unionByName(doc(steps.where("kind = 'tool'"), "actions", F.col("target")))
    words = [r[0] for r in spark.range(1).select(F.explode(tokens(F.lit(text)))).collect()]
    found = pieces.scored(pieces.search_fields(fields), words).join(pieces.where_query(rows, filters), F.col("doc") == F.col("piece_id"))
    hits = found.select("doc", F.floor(F.col("score") * 1e6 + 0.5).cast("bigint").alias("score_e6"), "hits", "start")
    n = hits.agg(F.count("*").alias("total"))
    return hits.orderBy(F.desc("score_e6"), F.desc("start"), "doc").limit(limit).crossJoin(F.broadcast(n)).select("doc", "score_e6", "hits", "total")  # one row


NAMES = (piece_outcomes, piece_backtracks, criteria, constraints, criteria_checked, verification_rollup, work_types, session_facts, filter_ledger, search_ledger)
QUERIES = {f.__name__: f for f in NAMES}

_ACT = first_rule_sql(S.ACTS, "other")
_FX = _PIECE + f""", fx AS (SELECT *, CASE WHEN kind = 'tool' THEN {_ACTION} END AS action, CASE WHEN kind = 'tool' THEN {_RESULT} END AS result, CASE kind WHEN 'ask' THEN 'ask' WHEN 'say' THEN {_ACT} END AS act,
  CASE WHEN kind = 'tool' THEN TRY_CAST(nullif(regexp_extract(concat_ws(' ', target, CASE WHEN NOT err THEN out END), '(?:pull/|PR #|#)([0-9]{{1,6}})', 1), '') AS BIGINT) END AS pr, max(i) OVER (PARTITION BY session) AS final_i FROM pc),
 fs AS (SELECT *, coalesce(action = 'edit' AND regexp_matches(target, {_Q(S.CODE)}), false) AS code FROM fx)"""
_CH = "('test', 'typecheck', 'lint', 'build')"
_OUTC = _FX + f""", oa AS (SELECT session, piece, max(i) FILTER (action IN ('edit', 'commit')) AS change_at, max(i) FILTER (code) AS code_at, max(i) FILTER (action IN ('ship', 'deploy') AND result IN ('ok', 'pass')) AS ship_at, max(i) FILTER (kind = 'say') AS say_at,
   max(i) FILTER (kind = 'tool') AS tool_at, max(final_i) AS final_i, max(i) AS last_i, count(*) AS n_steps FROM fs GROUP BY ALL),
 ob2 AS (SELECT f.session, f.piece, coalesce(bool_or(action IN {_CH} AND result = 'pass' AND i > change_at), false) AS verified, coalesce(bool_or(action IN {_CH} AND result = 'pass' AND i < ship_at AND i >= coalesce(change_at, -1)), false) AS ship_checked,
   coalesce(bool_or(action IN {_CH} AND result NOT IN ('fail', 'denied') AND i > code_at), false) AS cac, arg_max(act, i) FILTER (kind = 'say') AS final_act, arg_max(length(text), i) FILTER (kind = 'say') AS final_size FROM fs f JOIN oa USING (session, piece) GROUP BY ALL),
 oc AS (SELECT session, piece, count(*) AS tail, count(*) FILTER (result IN ('denied', 'fail')) AS tail_bad, bool_or(result = 'denied') AS tail_denied FROM (SELECT *, row_number() OVER (PARTITION BY session, piece ORDER BY i DESC) AS k FROM fs WHERE kind = 'tool') WHERE k <= 4 GROUP BY ALL),
 od AS (SELECT *, tool_at IS NOT NULL AND (say_at IS NULL OR tool_at > say_at) AS eot, last_i = final_i AS ends, change_at IS NOT NULL AS changed, coalesce(final_size > 160, false) AS longer FROM oa JOIN ob2 USING (session, piece) LEFT JOIN oc USING (session, piece)),
 oe AS (SELECT *, CASE WHEN ship_at IS NOT NULL THEN CASE WHEN ship_checked THEN 'shipped_checked' ELSE 'shipped_unchecked' END WHEN final_act = 'handback' THEN 'handed_back'
   WHEN coalesce(final_act = 'blocked', false) OR coalesce(tail >= 2 AND tail_bad = tail, false) THEN CASE WHEN say_at IS NOT NULL AND NOT eot THEN 'blocked_reported' WHEN coalesce(tail_denied, false) THEN 'blocked_wall' ELSE 'abandoned' END
   WHEN ends AND eot THEN 'open' WHEN say_at IS NOT NULL AND NOT eot AND longer THEN CASE WHEN NOT changed THEN 'answered' WHEN verified THEN 'verified_change' ELSE 'reported_change' END
   WHEN verified THEN 'verified_change' WHEN NOT changed AND longer THEN 'answered' WHEN final_act IN ('claim_done', 'verification') THEN CASE WHEN changed THEN 'verified_change' ELSE 'answered' END WHEN ends THEN 'open' ELSE 'unclear' END AS outcome FROM od),
 out AS (SELECT session, piece, outcome, CASE outcome {' '.join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in T.OUTCOMES.items())} END AS status, CASE outcome {' '.join(f"WHEN '{k}' THEN {v[1]}::DOUBLE" for k, v in T.OUTCOMES.items())} END AS confidence, CASE WHEN code_at IS NOT NULL THEN cac END AS checked_after_change, n_steps FROM oe)"""
_CRIT = "list_concat(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(ask, {_Q(p)}) THEN struct_pack(criterion := '{k}', file := NULL::VARCHAR) END" for k, p in L.CRITERIA) + f"], lambda x: x IS NOT NULL), list_transform(list_distinct(regexp_extract_all(ask, {_Q(L.FILE_ASK)}, 1)), lambda x: struct_pack(criterion := 'file', file := x)))"
_CR = f""", cs0 AS (SELECT piece_id, ask, {_CRIT} AS found FROM pieces WHERE ask IS NOT NULL), cs1 AS (SELECT piece_id, CASE WHEN len(list_filter(found, lambda x: x.criterion IN ('tests', 'typecheck', 'build', 'answer', 'file'))) = 0 AND regexp_matches(ask, {_Q(L.CHANGE_ASK)}) THEN list_append(found, struct_pack(criterion := 'change_checked', file := NULL::VARCHAR)) ELSE found END AS found FROM cs0),
 cr AS (SELECT piece_id, 'c' || k AS id, c.criterion AS criterion, c.file AS file FROM (SELECT piece_id, generate_subscripts(found, 1) AS k, unnest(found) AS c FROM cs1))"""
_ok = "result NOT IN ('fail', 'denied')"
_last = lambda c, v: f"arg_max({v}, i) FILTER ({c})"
_CK = _FX + _CR + f""", fe AS (SELECT *, coalesce(max(i) FILTER (kind = 'tool' AND NOT pending AND code) OVER w, -1) AS code_at, max(i) FILTER (kind = 'tool' AND NOT pending AND action = 'edit') OVER w AS edit_at FROM fs WINDOW w AS (PARTITION BY piece_id)),
 tl AS (SELECT * FROM fe WHERE kind = 'tool' AND NOT pending),
 by1 AS (SELECT piece_id, {_last("contains(target, 'gh pr create') OR pr IS NOT NULL", _ok)} AS pull_request, {_last("regexp_matches(target, 'gh pr merge|git merge')", _ok)} AS merge, {_last("action = 'deploy'", _ok)} AS deploy, {_last("action = 'deploy' OR contains(target, 'publish')", _ok)} AS publish, {_last("action IN ('commit', 'ship')", _ok)} AS commit,
   {", ".join(f"{_last(f'action = {_Q(a)} AND i > code_at', _ok)} AS {k}, {_last(f'action = {_Q(a)} AND i > code_at', 'result = ' + _Q('pass'))} AS {k}_passed" for k, a in (("tests", "test"), ("typecheck", "typecheck"), ("build", "build")))}, {_last(f"action IN {_CH} AND i > edit_at", _ok)} AS change_checked, max(edit_at) AS edit_at FROM tl GROUP BY piece_id),
 by2 AS (SELECT piece_id, {_last("kind = 'say'", "length(text) > 160")} AS answer FROM fe GROUP BY piece_id), be AS (SELECT piece_id, regexp_extract(target, '([^/]*)$', 1) AS base, arg_max(result <> 'fail', i) AS wrote FROM tl WHERE action = 'edit' GROUP BY ALL),
 cj AS (SELECT cr.*, by1.* EXCLUDE (piece_id), CASE criterion {" ".join(f"WHEN '{k}' THEN {k}" for k in ("pull_request", "merge", "deploy", "publish", "commit", "tests", "typecheck", "build", "answer", "change_checked"))} WHEN 'file' THEN wrote END AS met FROM cr LEFT JOIN by1 USING (piece_id) LEFT JOIN by2 USING (piece_id) LEFT JOIN be ON be.piece_id = cr.piece_id AND be.base = regexp_extract(cr.file, '([^/]*)$', 1)),
 ck AS (SELECT piece_id, id, criterion, CASE WHEN criterion = 'change_checked' AND edit_at IS NULL THEN 'unmet' WHEN met IS NULL THEN 'unknown' WHEN met THEN 'met' ELSE 'unmet' END AS status, CASE WHEN criterion = 'change_checked' AND edit_at IS NULL THEN 0.5::DOUBLE WHEN met IS NULL THEN 0.3::DOUBLE
   WHEN criterion IN ('pull_request', 'file') THEN 0.85::DOUBLE WHEN criterion IN ('merge', 'deploy', 'publish', 'commit') THEN 0.8::DOUBLE WHEN CASE criterion WHEN 'tests' THEN tests_passed WHEN 'typecheck' THEN typecheck_passed WHEN 'build' THEN build_passed END THEN 0.9::DOUBLE ELSE 0.6::DOUBLE END AS confidence FROM cj)"""
_VER = f""", vr AS (SELECT piece_id, CASE WHEN n = 0 THEN 'unverified' WHEN good = n THEN 'passed' WHEN good > 0 THEN 'partial' WHEN op = n THEN 'inconclusive' ELSE 'failed' END AS verification, n AS n_checks FROM
 (SELECT piece_id, count(*) FILTER (c) AS n, count(*) FILTER (c AND result = 'pass') AS good, count(*) FILTER (c AND result = 'ok') AS op FROM (SELECT *, coalesce(kind = 'tool' AND NOT pending AND action IN {_CH} AND i > coalesce(max(i) FILTER (kind = 'tool' AND NOT pending AND action = 'edit') OVER (PARTITION BY piece_id), -1) AND result <> 'denied', false) AS c FROM fs) GROUP BY piece_id))"""
_WT = f""", wr0 AS (SELECT piece_id, count(*) FILTER (kind = 'tool') AS n, {", ".join(f"coalesce(count(*) FILTER (action IN ({a})) / greatest(1, count(*) FILTER (kind = 'tool')), 0)::DOUBLE AS {k}" for k, a in (("edits", "'edit'"), ("reads", "'read', 'search', 'git_read'"), ("ships", "'commit', 'ship', 'deploy'"), ("web", "'web'")))},
   max(i) FILTER (action IN ('commit', 'ship', 'deploy') AND NOT err) AS ship_i, min(i) FILTER (action = 'edit' AND NOT err AND regexp_matches(target, '\\.(md|mdx|txt|docx)$')) AS prose_i, min(i) FILTER (action = 'edit' AND NOT err AND regexp_matches(target, '\\.(css|scss|svg|png|jpg|mp4|tsx)$')) AS visual_i FROM fs GROUP BY piece_id),
 wr AS (SELECT wr0.*, p.ask, coalesce(ship_i > prose_i, false) AS prose, coalesce(ship_i > visual_i, false) AS visual FROM wr0 JOIN pieces p USING (piece_id) WHERE p.ask IS NOT NULL), wt AS ({WT.classify_sql('wr')})"""
_top = lambda c, v: f"(SELECT session, max(struct_pack(n := n, v := v)).v AS {c} FROM (SELECT sessionId AS session, {v} AS v, count(*) AS n FROM claude WHERE sessionId IS NOT NULL AND {v} IS NOT NULL GROUP BY ALL) GROUP BY session)"
_REPO = r"nullif(regexp_extract(regexp_replace(regexp_replace(cwd, '/\.(claude|codex|cursor)/worktrees/[^/]+.*$', ''), '/worktrees/[^/]+$', ''), '([^/]*)$', 1), '')"
_SF = f"sf AS (SELECT s.session, {_REPO} AS repo, cwd, mode, model, CASE {' '.join(f'WHEN coalesce(regexp_matches(lower(model), {_Q(p)}), false) THEN {_Q(n)}' for n, p in L.PROVIDERS)} ELSE 'unknown' END AS provider, CASE mode {' '.join(f'WHEN {_Q(k)} THEN {_Q(v)}' for k, v in L.AUTHORITY.items())} ELSE 'unknown/unknown' END AS authority FROM (SELECT DISTINCT sessionId AS session FROM claude WHERE sessionId IS NOT NULL) s LEFT JOIN {_top('cwd', 'cwd')} a USING (session) LEFT JOIN {_top('mode', 'permissionMode')} b USING (session) LEFT JOIN {_top('model', 'message.model')} c USING (session))"
_LED = _OUTC + _CK[len(_FX):] + _VER + _WT + ", " + _SF + f""", led AS (SELECT p.piece_id, p.session, p.piece, p.start, p.ask, o.outcome, CASE outcome {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in L.SUCCESS.items())} END AS plain, o.confidence, vr.verification, coalesce(wt.work_type, 'other') AS work_type, wr0.n AS n_calls, sf.repo,
   coalesce(um.n, 0) AS n_unmet, um.n IS NOT NULL AS has_unmet FROM pieces p JOIN out o USING (session, piece) JOIN vr USING (piece_id) JOIN wr0 USING (piece_id) LEFT JOIN wt USING (piece_id) LEFT JOIN sf ON sf.session = p.session LEFT JOIN (SELECT piece_id, count(*) AS n FROM ck WHERE status = 'unmet' GROUP BY 1) um USING (piece_id)),
 lg AS (SELECT *, CASE WHEN plain = 'succeeded' AND has_unmet THEN 'partially_succeeded' ELSE plain END AS success FROM led)"""
_FLAT = r"trim(regexp_replace(regexp_replace(regexp_replace(ask, '</?[A-Za-z][^>]*>', ' ', 'g'), '[*_`#>]+', '', 'g'), '\s+', ' ', 'g'))"
SQL = {
    "piece_outcomes": _OUTC + "SELECT * FROM out",
    "criteria": _PIECE + _CR + "SELECT piece_id, id, criterion, file FROM cr",
    "constraints": _PIECE + f"SELECT piece_id, k AS nth, said FROM (SELECT piece_id, unnest(s) AS said, generate_subscripts(s, 1) AS k FROM (SELECT piece_id, regexp_extract_all(ask, {_Q(L.CONSTRAINT)}, 1)[1:10] AS s FROM pieces WHERE ask IS NOT NULL))",
    "criteria_checked": _CK + "SELECT * FROM ck",
    "verification_rollup": _FX + _VER + "SELECT * FROM vr",
    "work_types": _FX + _WT + "SELECT * FROM wt",
    "session_facts": "WITH " + _SF + "SELECT * FROM sf",
    "filter_ledger": _LED + "SELECT piece_id, outcome, success, confidence, verification, work_type, n_calls, repo FROM lg WHERE (starts_with(outcome, 'succ') OR starts_with(success, 'succ')) AND coalesce(confidence, 1) >= 0.6 AND n_calls > 2",
    "search_ledger": _LED + f""", ttl AS (SELECT piece_id, {_FLAT} AS flat FROM pieces WHERE ask IS NOT NULL), tt2 AS (SELECT piece_id, coalesce(nullif(regexp_extract(flat, '^(.*?[.!?])(?: |$)', 1), ''), flat) AS cut FROM ttl),
        fl AS (SELECT piece_id AS doc, 'summary' AS field, CASE WHEN length(cut) > 72 THEN left(cut, 71) || '…' ELSE cut END AS text FROM tt2 UNION ALL SELECT piece_id, 'objective', ask FROM pieces UNION ALL SELECT piece_id, 'outcome', replace(outcome, '_', ' ') FROM lg UNION ALL SELECT piece_id, 'criteria', replace(criterion, '_', ' ') FROM cr
          UNION ALL SELECT piece_id, 'artifacts', target FROM fs WHERE action = 'edit' AND NOT err UNION ALL SELECT piece_id, 'actions', target FROM fs WHERE kind = 'tool'),
        ix AS (SELECT DISTINCT doc, field, term FROM (SELECT doc, field, unnest({_TOK('text')}) AS term FROM fl)), wg AS (SELECT *, CASE field {' '.join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in pieces.FIELDS.items())} END AS w FROM ix),
        sz AS (SELECT doc, sum(w) AS len FROM wg GROUP BY doc), stt AS (SELECT count(*) AS n, avg(len) AS avg FROM sz), qt AS (SELECT DISTINCT unnest({_TOK(_Q('nightly export webhook'))}) AS term),
        po AS (SELECT doc, term, sum(w) AS f FROM wg SEMI JOIN qt USING (term) GROUP BY doc, term), dfr AS (SELECT term, count(*) AS df FROM po GROUP BY term),
        s AS (SELECT doc, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / avg))) AS s, count(*) AS hits FROM po JOIN dfr USING (term) JOIN sz USING (doc) CROSS JOIN stt GROUP BY doc),
        h AS (SELECT s.doc, CAST(floor(s * (hits / (SELECT count(*) FROM qt)) * (hits / (SELECT count(*) FROM qt)) * 1e6 + 0.5) AS BIGINT) AS score_e6, hits, lg.start FROM s JOIN lg ON lg.piece_id = s.doc WHERE lg.verification = 'unverified')
        SELECT doc, score_e6, hits, (SELECT count(*) FROM h) AS total FROM h ORDER BY score_e6 DESC, start DESC, doc LIMIT 20""",
    "piece_backtracks": _FX + f""", b0 AS (SELECT *, row_number() OVER (PARTITION BY session, piece, kind ORDER BY i) AS nth, coalesce(last_value(CASE WHEN kind <> 'say' THEN coalesce(rejected, false) END IGNORE NULLS) OVER (PARTITION BY session, piece ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS aft,
        coalesce(bool_or(rejected) OVER n, false) AS n_rej, coalesce(bool_or(result = 'fail') OVER n, false) AS n_fail, coalesce(bool_or(result = 'denied') OVER n, false) AS n_den, coalesce(bool_or(kind = 'ask') OVER n, false) AS n_ask FROM fs WINDOW n AS (PARTITION BY session, piece ORDER BY i ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)),
        b1 AS (SELECT session, piece, i, kind = 'ask' AS asked, CASE WHEN kind = 'ask' OR n_rej THEN 'person' WHEN n_fail THEN 'error' WHEN n_den THEN 'denied' WHEN n_ask THEN 'person' ELSE 'evidence' END AS trigger FROM b0 WHERE (kind = 'ask' AND nth > 1 AND (coalesce({_JUDGED} = 'correction', false) OR aft)) OR act = 'course_change'),
        b2 AS (SELECT *, row_number() OVER (PARTITION BY session, piece ORDER BY i) AS k FROM b1),
        w AS (SELECT session, piece, k, i, trigger, i AS last_i, trigger AS last_t, true AS kept FROM b2 WHERE k = 1 UNION ALL
          SELECT x.session, x.piece, x.k, x.i, x.trigger, CASE WHEN x.i - w.last_i <= 2 AND (NOT x.asked OR w.last_t = 'person') THEN w.last_i ELSE x.i END, CASE WHEN x.i - w.last_i <= 2 AND (NOT x.asked OR w.last_t = 'person') THEN w.last_t ELSE x.trigger END, NOT (x.i - w.last_i <= 2 AND (NOT x.asked OR w.last_t = 'person')) FROM w JOIN b2 x ON x.session = w.session AND x.piece = w.piece AND x.k = w.k + 1)
        SELECT session, piece, i, trigger FROM w WHERE kept""".replace("WITH\n", "WITH RECURSIVE\n", 1),
}
SQL["piece_backtracks"] = SQL["piece_backtracks"].replace("WITH\n", "WITH RECURSIVE\n", 1)

from weftline.plans.work import SQL as _WORK_SQL  # noqa: E402

SQL["label_inheritance"] = f"""WITH RECURSIVE own AS MATERIALIZED ({SQL["work_types"]}), up AS MATERIALIZED (SELECT b AS piece_id, m.a AS before FROM (SELECT b, max(struct_pack(c := confidence, a := a)) AS m FROM ({_WORK_SQL["continuations"]}) GROUP BY b) WHERE b IN (SELECT piece_id FROM own WHERE work_type IN ('other', 'follow_up') OR confidence < {WT.LOW})),
        r AS (SELECT piece_id, piece_id AS top, 0 AS n FROM own UNION ALL SELECT r.piece_id, up.before, n + 1 FROM r JOIN up ON up.piece_id = r.top), e AS (SELECT piece_id, arg_max(top, n) AS top FROM r GROUP BY piece_id)
        SELECT e.piece_id, own.work_type, e.top <> e.piece_id AS inherited FROM e JOIN own ON own.piece_id = e.top"""
