"""Queries over the events of sessions: outlines, windows, spans, walls, signals, corpus aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weftline.functions.rules import first_rule_sql
from weftline.functions.text import error_signature, first_sentence, head_tail
from weftline.operators import events as E
from weftline.operators import steps as S
from weftline.sources.tables import table


def by_i() -> W:
    """A session's events in order."""
    return W.partitionBy("session").orderBy("i")


def events(spark: SparkSession, d: str) -> DataFrame:
    return E.chat_events(table(spark, d, "claude"))


def session_events(spark: SparkSession, d: str) -> DataFrame:
    """The normalised events of the chat log."""
    return events(spark, d).select("session", "i", "kind", "text", "tool", "target", "call_id", "pending", "err", "denied", "rejected", "err_text", "out")


def rollout_events(spark: SparkSession, d: str) -> DataFrame:
    return E.rollout_events(table(spark, d, "codex")).select("session", "i", "kind", "text", "tool", "target", "pending", "err")


def store_events(spark: SparkSession, d: str) -> DataFrame:
    return E.store_events(table(spark, d, "oc_message"), table(spark, d, "oc_part")).select("session", "i", "kind", "text", "tool", "target", "pending", "err")


def all_events(spark: SparkSession, d: str) -> DataFrame:
    """Union of the events of all clients, counted per client and kind."""
    both = events(spark, d).unionByName(E.rollout_events(table(spark, d, "codex"))).unionByName(E.store_events(table(spark, d, "oc_message"), table(spark, d, "oc_part")))
    return both.groupBy("client", "kind").agg(F.count("*").alias("n"), F.count_distinct("session").alias("sessions"))


def moves(spark: SparkSession, d: str) -> DataFrame:
    return S.with_moves(events(spark, d))


def move_string() -> F.Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "move"))), lambda x: x["move"]), "")


def session_outline(spark: SparkSession, d: str) -> DataFrame:
    """One string of moves per session, in order."""
    return moves(spark, d).groupBy("session").agg(move_string().alias("moves"), F.count("*").alias("n_calls"))


def move_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Measures of a session's work from its moves alone."""
    m = session_outline(spark, d)
    n = lambda p: (F.length("moves") - F.length(F.regexp_replace("moves", p, ""))).cast("bigint")
    first_change = F.instr("moves", "c")
    last_change = F.length("moves") - F.instr(F.reverse("moves"), "c") + 1
    return m.select(
        "session", n("p").alias("probes"), n("c").alias("changes"), n("[XD]").alias("fails"), F.when(first_change > 0, first_change - 1).cast("bigint").alias("explore_before_change"),
        F.when(first_change > 0, F.substring("moves", last_change + 1, 1_000_000).rlike("[hs]")).alias("verified"), F.regexp_count("moves", F.lit("c[^c]*h")).cast("bigint").alias("change_check_loops"),
        (n("[XD]") / F.length("moves")).alias("fail_rate"),
    )


def status_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Status of a session's work by the cascade over its moves."""
    m = session_outline(spark, d)
    fails = F.length("moves") - F.length(F.regexp_replace("moves", "[XD]", ""))
    status = (
        F.when(F.contains("moves", F.lit("s")), "outcome").when(F.col("moves").rlike("c[^XD]*$") & F.contains("moves", F.lit("h")), "outcome")
        .when(F.substring("moves", -6, 6).rlike("[XD][XD]$") | (fails * 2 > F.length("moves")), "abandoned").otherwise("open")
    )
    return m.select("session", status.alias("status"))


def ask_spans(spark: SparkSession, d: str) -> DataFrame:
    """Gaps and islands: the stretches of events between a person's asks, bare continuations taken as part of what they continue."""
    ev = events(spark, d)
    opens = (F.col("kind") == "ask") & ~F.coalesce(F.col("text").rlike(E.CONTINUE), F.lit(False))
    owned = ev.withColumn("span", F.sum(F.when(opens, 1).otherwise(0)).over(by_i().rowsBetween(W.unboundedPreceding, 0)))
    return owned.groupBy("session", "span").agg(F.min("i").alias("a"), F.max("i").alias("b"), F.count("*").alias("n_events"), F.count_if(F.col("err")).alias("n_errs"))


def retry_backtracks(spark: SparkSession, d: str) -> DataFrame:
    """A call that works right after a failed one of the same lane and tool with another target, fewer than five events later."""
    m = moves(spark, d)
    failed = F.when(F.col("err"), F.struct("i", "lane", "tool", "target"))
    m = m.withColumn("before", F.last(failed, ignorenulls=True).over(by_i().rowsBetween(W.unboundedPreceding, -1)))
    hit = ~F.col("err") & (F.col("before.lane") == F.col("lane")) & (F.col("before.tool") == F.col("tool")) & (F.col("before.target") != F.col("target")) & (F.col("i") - F.col("before.i") < 5)
    return m.where(hit).select("session", "i", F.col("before.i").alias("failed_at"), "lane")


def after_rejection(spark: SparkSession, d: str) -> DataFrame:
    """A person's text whose nearest earlier event, messages of the agent apart, is a rejected call: its reason."""
    ev = events(spark, d)
    other = F.when(F.col("kind") != "say", F.coalesce("rejected", F.lit(False)))
    ev = ev.withColumn("reason_of_rejection", F.coalesce(F.last(other, ignorenulls=True).over(by_i().rowsBetween(W.unboundedPreceding, -1)), F.lit(False)))
    return ev.where("kind = 'ask'").select("session", "i", "reason_of_rejection")


def first_denials(spark: SparkSession, d: str) -> DataFrame:
    """The first denied call of each tool in a session."""
    den = events(spark, d).where("denied").withColumn("nth", F.row_number().over(W.partitionBy("session", "tool").orderBy("i")))
    return den.where("nth = 1").select("session", "tool", "i")


def step_facts(spark: SparkSession, d: str) -> DataFrame:
    """Action and result of every call."""
    return S.with_facts(events(spark, d)).where("kind = 'tool'").select("session", "i", "action", "result", "code", "pr")


def message_acts(spark: SparkSession, d: str) -> DataFrame:
    """What every message does."""
    return S.with_acts(events(spark, d)).select("session", "i", "act")


def signals(spark: SparkSession, d: str) -> DataFrame:
    return S.judgments(events(spark, d))


def wall_hits(spark: SparkSession, d: str) -> DataFrame:
    return S.wall_hits(events(spark, d)).select("session", "i", "sig", "named")


def wall_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Walls over sessions: how many sessions and calls, the calls after the first session that met it, and whether it is a rule to guard by."""
    hit = S.wall_hits(events(spark, d))
    per = hit.groupBy("sig", "session").agg(F.count("*").alias("n"), F.min("row_id").alias("first"), F.max("named").alias("named"))
    nth = F.row_number().over(W.partitionBy("sig").orderBy("first"))
    per = per.withColumn("nth", nth)
    return per.groupBy("sig").agg(
        F.max("named").alias("named"), F.count("*").alias("sessions"), F.sum("n").alias("calls"), F.sum(F.when(F.col("nth") > 1, F.col("n")).otherwise(0)).alias("rediscovered"), (F.count("*") >= 3).alias("guarded"),
    )


def session_counters(ev: DataFrame, calls: DataFrame) -> DataFrame:
    """One row per session: counts of asks, says, calls, errors, denials, changes, checks, and its first time."""
    a = ev.groupBy("session").agg(F.min("ts").alias("start"), F.count_if(F.col("kind") == "ask").alias("asks"), F.count_if(F.col("kind") == "say").alias("says"))
    b = calls.groupBy("session").agg(
        F.count("*").alias("calls"), F.count_if("err").alias("errs"), F.count_if("denied").alias("denied"), F.count_if(F.col("lane") == "change").alias("changes"), F.count_if(F.col("lane").isin("check", "ship")).alias("checks"))
    return a.join(b, "session", "left").fillna(0, ["calls", "errs", "denied", "changes", "checks"])


def corpus_totals(spark: SparkSession, d: str) -> DataFrame:
    ev = events(spark, d)
    c = session_counters(ev, S.with_moves(ev))
    names = ("asks", "says", "calls", "errs", "denied", "changes", "checks")
    return c.agg(F.count("*").alias("sessions"), *[F.sum(n).alias(n) for n in names], F.count_if((F.col("changes") > 0) & (F.col("checks") == 0)).alias("unchecked"))


def weekly_series(spark: SparkSession, d: str) -> DataFrame:
    ev = events(spark, d)
    c = session_counters(ev, S.with_moves(ev))
    return c.groupBy(F.date_format(F.date_trunc("week", "start"), "yyyy-MM-dd").alias("week")).agg(F.count("*").alias("sessions"), F.sum("calls").alias("calls"), F.sum("errs").alias("errs"))


def corpus_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    """All, by week and by tool in one pass of grouping sets."""
    m = moves(spark, d).withColumn("week", F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd")).withColumn("tool", F.lower("tool"))
    return m.groupingSets([[], [F.col("week")], [F.col("tool")]], F.col("week"), F.col("tool")).agg(F.count("*").alias("calls"), F.count_if("err").alias("errs"), F.grouping_id().cast("bigint").alias("gid"))


def error_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Ten bins of the sessions' share of failed calls."""
    c = moves(spark, d).groupBy("session").agg((F.count_if("err") / F.count("*")).alias("share"))
    return c.groupBy(F.least(F.lit(9), F.floor(F.col("share") * 10)).cast("bigint").alias("bin")).agg(F.count("*").alias("sessions"))


def call_results(spark: SparkSession, d: str) -> DataFrame:
    """Calls left-joined to their results, counted by tool."""
    ev = events(spark, d).where("kind = 'tool'")
    return ev.groupBy(F.lower("tool").alias("tool")).agg(F.count("*").alias("calls"), F.count_if("pending").alias("pending"), F.count_if("err").alias("errs"), F.count_if("denied").alias("denied"))


def usage_last(spark: SparkSession, d: str) -> DataFrame:
    """Usage by message id: the first position stays, the last values win."""
    rows = table(spark, d, "claude").where("sessionId is not null and message.id is not null and message.usage is not null")
    agg = rows.groupBy(F.col("sessionId").alias("session"), F.col("message.id").alias("message_id")).agg(F.min("row_id").alias("first_row"), F.max_by("message.usage", "row_id").alias("u"))
    return agg.select("session", "message_id", "first_row", F.col("u.input_tokens").cast("bigint").alias("input"), F.col("u.cache_read_input_tokens").cast("bigint").alias("cached"), F.col("u.output_tokens").cast("bigint").alias("output"))


def usage_in_spans(spark: SparkSession, d: str) -> DataFrame:
    """Tokens inside the stretches between asks: each usage belongs to the last event at or before it."""
    use = usage_last(spark, d)
    ev = events(spark, d)
    opens = (F.col("kind") == "ask") & ~F.coalesce(F.col("text").rlike(E.CONTINUE), F.lit(False))
    marks = ev.where(opens).select("session", F.col("row_id").alias("first_row"), F.lit(1).alias("open"), F.lit(0).cast("bigint").alias("input"), F.lit(0).cast("bigint").alias("output"))
    both = marks.unionByName(use.select("session", "first_row", F.lit(0).alias("open"), F.coalesce("input", F.lit(0)).alias("input"), F.coalesce("output", F.lit(0)).alias("output")))
    w = W.partitionBy("session").orderBy("first_row", F.desc("open")).rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn("span", F.sum("open").over(w)).groupBy("session", "span").agg(F.sum("input").alias("input"), F.sum("output").alias("output"))


def reasoning_asof(spark: SparkSession, d: str) -> DataFrame:
    """As-of: each piece of reasoning goes before the next event of its session, by union and one window instead of a join."""
    claude = table(spark, d, "claude")
    r = E.reasoning(claude).select("session", "row_id", F.lit(0).alias("after"), F.lit(None).cast("bigint").alias("i"), F.length("text").alias("size"))
    ev = events(spark, d).select("session", "row_id", F.lit(1).alias("after"), "i", F.lit(None).cast("int").alias("size"))
    w = W.partitionBy("session").orderBy(F.col("row_id").desc(), F.col("after").desc(), F.col("i").desc()).rowsBetween(W.unboundedPreceding, -1)
    both = r.unionByName(ev).withColumn("before_i", F.last("i", ignorenulls=True).over(w))
    return both.where("after = 0").select("session", "row_id", "before_i", F.col("size").cast("bigint").alias("size"))


def error_signatures(spark: SparkSession, d: str) -> DataFrame:
    ev = events(spark, d).where("err")
    return ev.withColumn("signature", error_signature(F.lower("tool"), F.col("err_text"))).where("signature is not null").groupBy("signature").agg(F.count("*").alias("n"))


def ask_titles(spark: SparkSession, d: str) -> DataFrame:
    """First sentences of the asks."""
    return events(spark, d).where("kind = 'ask'").select("session", "i", first_sentence(F.col("text")).alias("title"))


def note_clips(spark: SparkSession, d: str) -> DataFrame:
    """Head and tail of a session's notes: the first two and the last two positions."""
    says = events(spark, d).where("kind = 'say'").groupBy("session").agg(F.array_sort(F.collect_list("i")).alias("at"))
    return says.select("session", F.array_join(head_tail(F.col("at"), 2, 2), ",").alias("kept"), F.size("at").cast("bigint").alias("n"))


def move_buckets(spark: SparkSession, d: str, width: int = 10) -> DataFrame:
    """Downsampled moves: ``width`` buckets a session, each with its gravest move (D, X, s, h, c, d, then the rest)."""
    m = moves(spark, d).withColumn("k", F.row_number().over(by_i()) - 1).withColumn("n", F.count("*").over(W.partitionBy("session")))
    rank = F.array_position(F.array(*map(F.lit, "rpdchsXD")), F.col("move"))
    b = m.withColumn("bucket", F.floor(F.col("k") * width / F.col("n")).cast("bigint"))
    return b.groupBy("session", "bucket").agg(F.max_by("move", rank).alias("move"))


def keyset_page(spark: SparkSession, d: str, after: str = "80000000", size: int = 50) -> DataFrame:
    """One page of sessions behind a cursor; the limit is the feature."""
    s = events(spark, d).groupBy("session").agg(F.count("*").alias("n_events"))
    return s.where(F.col("session") > after).orderBy("session").limit(size)


def gap_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions by silence: a person's events that lie less than 30 minutes apart belong together."""
    ev = table(spark, d, "events").select("user_id", "event_id", "ts", "value", "event_type")
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    new = F.coalesce(F.col("ts") - F.lag("ts").over(w) > F.expr("interval 30 minutes"), F.lit(True))
    s = ev.withColumn("nth", F.sum(F.when(new, 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return s.groupBy("user_id", "nth").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))


NAMES = (
    session_events, session_outline, move_metrics, status_cascade, ask_spans, retry_backtracks, after_rejection, first_denials, step_facts, message_acts, signals, wall_hits, wall_rollup, corpus_totals, weekly_series,
    corpus_grouping_sets, error_histogram, call_results, usage_last, usage_in_spans, reasoning_asof, error_signatures, ask_titles, note_clips, move_buckets, keyset_page, gap_sessions, rollout_events, store_events, all_events,
)
QUERIES = {f.__name__: f for f in NAMES}

from weftline.functions.commands import action_sql, lane_sql  # noqa: E402

_ACTION, _LANE = action_sql(), lane_sql()
_CODE = "CASE lane " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.LANE_CODE.items()) + " END"
_MV = f"mv AS (SELECT *, CASE WHEN denied THEN 'D' WHEN err THEN 'X' ELSE {_CODE} END AS move FROM (SELECT *, {_LANE} AS lane FROM (SELECT *, {_ACTION} AS action FROM ev WHERE kind = 'tool')))"
_WITH = "WITH" + E.EVENTS_SQL
_OUT = _WITH + f", {_MV}, outline AS (SELECT session, string_agg(move, '' ORDER BY i) AS moves, count(*) AS n_calls FROM mv GROUP BY session)"
_OPENS = f"kind = 'ask' AND NOT regexp_matches(text, '{E.CONTINUE}')"
_SIG = r"""left(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(list_filter(list_transform(string_split(err_text, chr(10)), lambda x: trim(x)), lambda x: length(x) > 8 AND NOT regexp_matches(lower(x), '^(exit code|process exited|wall time|output:)'))[1]),
 '[a-z0-9_.@~-]*(?:/[a-z0-9_.@~-]+)+', '<path>', 'g'), '[0-9a-f]{7,}', '<id>', 'g'), '[0-9]+(?:\.[0-9]+)?', 'n', 'g'), '"[^"]*"', '"…"', 'g'), '''[^'']*''', '"…"', 'g'), '^(?:error|fatal)[: ]+', ''), '\s+', ' ', 'g')), 90)"""
_WALL = first_rule_sql(S.WALLS)
_SLIP = f"(coalesce(regexp_matches(tool, '{S.SLIP_TOOL}'), false) OR coalesce(regexp_matches(err_text, '{S.SLIP_TEXT}'), false))"
_HITS = f"""hits AS (SELECT *, coalesce(wall, CASE WHEN NOT {_SLIP} AND length(line) > 6 THEN tool || ': ' || line END) AS sig FROM
 (SELECT *, {_WALL} AS wall, {_SIG} AS line FROM (SELECT *, CASE WHEN denied THEN 'yes' ELSE 'no' END AS denied_text FROM ev WHERE kind = 'tool' AND err AND NOT rejected)))"""
_COUNTERS = """sc AS (SELECT a.session, start, asks, says, coalesce(calls, 0) AS calls, coalesce(errs, 0) AS errs, coalesce(denied, 0) AS denied, coalesce(changes, 0) AS changes, coalesce(checks, 0) AS checks FROM
 (SELECT session, min(ts) AS start, count(*) FILTER (kind = 'ask') AS asks, count(*) FILTER (kind = 'say') AS says FROM ev GROUP BY session) a LEFT JOIN
 (SELECT session, count(*) AS calls, count(*) FILTER (err) AS errs, count(*) FILTER (denied) AS denied, count(*) FILTER (lane = 'change') AS changes, count(*) FILTER (lane IN ('check', 'ship')) AS checks FROM mv GROUP BY session) b USING (session))"""
_RESULT = f"CASE WHEN pending THEN 'pending' WHEN denied THEN 'denied' WHEN err THEN 'fail' WHEN regexp_matches(coalesce(out, ''), '{S.FAILED}') THEN 'fail' WHEN regexp_matches(coalesce(out, ''), '{S.PASSED}') THEN 'pass' ELSE 'ok' END"
_JUDGED = first_rule_sql(S.JUDGMENTS)
_USE = """use AS (SELECT sessionId AS session, message.id AS message_id, min(row_id) AS first_row, arg_max(message.usage, row_id) AS u FROM claude WHERE sessionId IS NOT NULL AND message.id IS NOT NULL AND message.usage IS NOT NULL GROUP BY ALL)"""

SQL = {
    "session_events": _WITH + "SELECT session, i, kind, text, tool, target, call_id, pending, err, denied, rejected, err_text, out FROM ev",
    "session_outline": _OUT + "SELECT * FROM outline",
    "move_metrics": _OUT + """SELECT session, length(moves) - length(replace(moves, 'p', '')) AS probes, length(moves) - length(replace(moves, 'c', '')) AS changes, length(moves) - length(regexp_replace(moves, '[XD]', '', 'g')) AS fails,
        CASE WHEN instr(moves, 'c') > 0 THEN instr(moves, 'c') - 1 END AS explore_before_change, CASE WHEN instr(moves, 'c') > 0 THEN regexp_matches(substr(moves, length(moves) - instr(reverse(moves), 'c') + 2), '[hs]') END AS verified,
        length(regexp_extract_all(moves, 'c[^c]*h')) AS change_check_loops, (length(moves) - length(regexp_replace(moves, '[XD]', '', 'g'))) / length(moves) AS fail_rate FROM outline""",
    "status_cascade": _OUT + """SELECT session, CASE WHEN contains(moves, 's') THEN 'outcome' WHEN regexp_matches(moves, 'c[^XD]*$') AND contains(moves, 'h') THEN 'outcome'
        WHEN regexp_matches(right(moves, 6), '[XD][XD]$') OR (length(moves) - length(regexp_replace(moves, '[XD]', '', 'g'))) * 2 > length(moves) THEN 'abandoned' ELSE 'open' END AS status FROM outline""",
    "ask_spans": _WITH + f"SELECT session, span, min(i) AS a, max(i) AS b, count(*) AS n_events, count(*) FILTER (err) AS n_errs FROM (SELECT *, CAST(sum(CASE WHEN {_OPENS} THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY i) AS BIGINT) AS span FROM ev) GROUP BY session, span",
    "retry_backtracks": _WITH + f", {_MV} SELECT session, i, b.i AS failed_at, lane FROM (SELECT *, last_value(CASE WHEN err THEN struct_pack(i := i, lane := lane, tool := tool, target := target) END IGNORE NULLS) OVER (PARTITION BY session ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM mv) WHERE NOT err AND b.lane = lane AND b.tool = tool AND b.target <> target AND i - b.i < 5",
    "after_rejection": _WITH + "SELECT session, i, coalesce(r, false) AS reason_of_rejection FROM (SELECT *, last_value(CASE WHEN kind <> 'say' THEN coalesce(rejected, false) END IGNORE NULLS) OVER (PARTITION BY session ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM ev) WHERE kind = 'ask'",
    "first_denials": _WITH + "SELECT session, tool, min(i) AS i FROM ev WHERE denied GROUP BY session, tool",
    "step_facts": _WITH + f"SELECT session, i, action, result, action = 'edit' AND regexp_matches(target, '{S.CODE}') AS code, TRY_CAST(nullif(regexp_extract(concat_ws(' ', target, out), '(?:pull/|PR #|#)([0-9]{{1,6}})', 1), '') AS BIGINT) AS pr FROM (SELECT *, {_ACTION} AS action, {_RESULT} AS result FROM ev WHERE kind = 'tool')",
    "message_acts": _WITH + f"SELECT session, i, CASE WHEN kind = 'ask' THEN 'ask' ELSE {first_rule_sql(S.ACTS, 'other')} END AS act FROM ev WHERE kind IN ('ask', 'say')",
    "signals": _WITH + f""", s1 AS (SELECT *, coalesce(max(CAST(kind = 'tool' AS INT)) OVER (PARTITION BY session ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS acted, CASE WHEN denied AND NOT rejected THEN split_part(err_text, chr(10), 1) END AS denial FROM ev),
        s2 AS (SELECT *, row_number() OVER (PARTITION BY session, tool, denial ORDER BY i) AS nth, kind = 'ask' AND length(trim(text)) >= 2 AND NOT starts_with(text, '[') AS usable, {_JUDGED} AS judged FROM s1),
        s3 AS (SELECT *, CASE WHEN rejected THEN 'rejection' WHEN denial IS NOT NULL AND nth = 1 THEN 'denial' WHEN usable AND judged = 'explicit_rule' THEN 'explicit_rule' WHEN usable AND acted AND length(text) <= 600 AND judged = 'correction' THEN 'correction' END AS signal FROM s2),
        s4 AS (SELECT session, i, signal, (CASE signal WHEN 'rejection' THEN regexp_extract(err_text, '(?s)[Uu]ser said:\\s*(.*)$', 1) WHEN 'denial' THEN denial ELSE text END) AS text FROM s3 WHERE signal IS NOT NULL)
        SELECT *, left(sha256(concat_ws('|', session, signal, CAST(i AS VARCHAR), text)), 16) AS signal_id FROM s4""",
    "wall_hits": _WITH + f", {_HITS} SELECT session, i, sig, wall IS NOT NULL AS named FROM hits WHERE sig IS NOT NULL",
    "wall_rollup": _WITH + f", {_HITS}, per AS (SELECT sig, session, count(*) AS n, min(row_id) AS first, bool_or(wall IS NOT NULL) AS named FROM hits WHERE sig IS NOT NULL GROUP BY sig, session), r AS (SELECT *, row_number() OVER (PARTITION BY sig ORDER BY first) AS nth FROM per) SELECT sig, bool_or(named) AS named, count(*) AS sessions, CAST(sum(n) AS BIGINT) AS calls, CAST(sum(CASE WHEN nth > 1 THEN n ELSE 0 END) AS BIGINT) AS rediscovered, count(*) >= 3 AS guarded FROM r GROUP BY sig",
    "corpus_totals": _WITH + f", {_MV}, {_COUNTERS} SELECT count(*) AS sessions, " + ", ".join(f"CAST(sum({n}) AS BIGINT) AS {n}" for n in ("asks", "says", "calls", "errs", "denied", "changes", "checks")) + ", count(*) FILTER (changes > 0 AND checks = 0) AS unchecked FROM sc",
    "weekly_series": _WITH + f", {_MV}, {_COUNTERS} SELECT strftime(date_trunc('week', start), '%Y-%m-%d') AS week, count(*) AS sessions, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(errs) AS BIGINT) AS errs FROM sc GROUP BY 1",
    "corpus_grouping_sets": _WITH + f", {_MV}, g AS (SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, lower(tool) AS tool, err FROM mv) SELECT week, tool, count(*) AS calls, count(*) FILTER (err) AS errs, grouping(week, tool) AS gid FROM g GROUP BY GROUPING SETS ((), (week), (tool))",
    "error_histogram": _WITH + ", c AS (SELECT count(*) FILTER (err) / count(*) AS share FROM ev WHERE kind = 'tool' GROUP BY session) SELECT CAST(least(9, floor(share * 10)) AS BIGINT) AS bin, count(*) AS sessions FROM c GROUP BY 1",
    "call_results": _WITH + "SELECT lower(tool) AS tool, count(*) AS calls, count(*) FILTER (pending) AS pending, count(*) FILTER (err) AS errs, count(*) FILTER (denied) AS denied FROM ev WHERE kind = 'tool' GROUP BY 1",
    "usage_last": f"WITH {_USE} SELECT session, message_id, first_row, CAST(u.input_tokens AS BIGINT) AS input, CAST(u.cache_read_input_tokens AS BIGINT) AS cached, CAST(u.output_tokens AS BIGINT) AS output FROM use",
    "usage_in_spans": _WITH + f", {_USE}, b AS (SELECT session, row_id AS first_row, 1 AS open, 0 AS input, 0 AS output FROM ev WHERE {_OPENS} UNION ALL SELECT session, first_row, 0, coalesce(u.input_tokens, 0), coalesce(u.output_tokens, 0) FROM use), s AS (SELECT *, CAST(sum(open) OVER (PARTITION BY session ORDER BY first_row, open DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS span FROM b) SELECT session, span, CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output FROM s GROUP BY session, span",
    "reasoning_asof": _WITH + ", r AS (SELECT session, row_id, length(b.thinking) AS size FROM block WHERE b.type = 'thinking' AND b.thinking IS NOT NULL) SELECT r.session, r.row_id, min(e.i) AS before_i, any_value(size) AS size FROM r LEFT JOIN ev e ON e.session = r.session AND e.row_id >= r.row_id GROUP BY r.session, r.row_id",
    "error_signatures": _WITH + f", s AS (SELECT lower(tool) AS tool, {_SIG} AS line FROM ev WHERE err) SELECT tool || ': ' || line AS signature, count(*) AS n FROM s WHERE length(line) > 6 GROUP BY 1",
    "ask_titles": _WITH + r""", a AS (SELECT session, i, trim(regexp_replace(regexp_replace(regexp_replace(text, '</?[A-Za-z][^>]*>', ' ', 'g'), '[*_`#>]+', '', 'g'), '\s+', ' ', 'g')) AS flat FROM ev WHERE kind = 'ask'), s AS (SELECT *, coalesce(nullif(regexp_extract(flat, '^(.*?[.!?])(?: |$)', 1), ''), flat) AS cut FROM a) SELECT session, i, CASE WHEN length(cut) > 72 THEN left(cut, 71) || '…' ELSE cut END AS title FROM s""",
    "note_clips": _WITH + "SELECT session, array_to_string(CASE WHEN len(p) > 4 THEN list_concat(p[1:2], p[-2:]) ELSE p END, ',') AS kept, len(p) AS n FROM (SELECT session, list(i ORDER BY i) AS p FROM ev WHERE kind = 'say' GROUP BY session)",
    "move_buckets": _WITH + f", {_MV}, k AS (SELECT session, move, i, row_number() OVER (PARTITION BY session ORDER BY i) - 1 AS k, count(*) OVER (PARTITION BY session) AS n FROM mv), b AS (SELECT session, CAST(floor(k * 10 / n) AS BIGINT) AS bucket, move, list_position(['r','p','d','c','h','s','X','D'], move) AS rank FROM k) SELECT session, bucket, arg_max(move, rank) AS move FROM b GROUP BY session, bucket",
    "keyset_page": _WITH + "SELECT session, count(*) AS n_events FROM ev WHERE session > '80000000' GROUP BY session ORDER BY session LIMIT 50",
    "gap_sessions": "WITH s AS (SELECT *, CAST(sum(CASE WHEN g IS NULL OR g > INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS nth FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events)) SELECT user_id, nth, min(ts) AS start, max(ts) AS \"end\", count(*) AS n, count(*) FILTER (event_type = 'error') AS errors FROM s GROUP BY user_id, nth",
}
