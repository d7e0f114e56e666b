"""Views, look-ups and evaluations over sessions, walls, signals and labels, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weftline.operators import events as E
from weftline.operators import ledger as L
from weftline.operators import pieces
from weftline.operators import steps as S
from weftline.operators.stage import written
from weftline.plans import ledger as PL
from weftline.plans.evaluation import _V, votes
from weftline.plans.sessions import _HITS, _OUT, _WITH, session_outline, status_cascade, wall_rollup
from weftline.plans.sessions import SQL as _SES_SQL
from weftline.plans.work import _LINK, _PIECE, _Q
from weftline.sources.tables import table

# Whose matter a named wall is, and what to do about it.
ADVICE = {
    "codex-sandbox": ("agents", "Work inside the workspace or ask for the path to be made writable."), "denied-home": ("agents", "Keep state inside the repository."), "denied-chain": ("agents", "Run one simple command per call."),
    "denied-gh-api": ("agents", "Use the pull request commands instead."), "denied-mcp": ("agents", "Use files and history as evidence."), "denied-web": ("agents", "Do not plan on look-ups outside."), "denied-other": ("agents", "Report that the tool is denied instead of retrying."),
    "disk-full": ("environment", "Check the free space before long builds."), "heap": ("environment", "Raise the heap or check a part."), "port": ("environment", "Reuse the server that runs."), "auth-expired": ("environment", "Ask for a new login."), "no-module": ("environment", "Install the packages first."),
}
#: Words of the feature vector: giving up, surprise, done.
FEATURE_WORDS = {"gives_up": r"(?i)\b(blocked|unable to|can(no|')t|not (possible|available|accessible)|giving up|denied|skip)", "surprise": r"(?i)\b(found|discovered|turns out|unexpected|root cause|real (issue|problem)|bug|incident|regression|broken|leak|storm|wedged|stuck)\b", "done": r"(?i)\b(merged|deployed|published|shipped|pushed|done|complete|landed|posted|created PR|opened PR)\b"}
CODEBOOK = {"outcome": "done", "abandoned": "dropped", "open": "open"}


def _events(spark: SparkSession, d: str) -> DataFrame:
    return E.chat_events(table(spark, d, "claude"))


def _map(m: dict[str, str], c: F.Column) -> F.Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in m.items() for x in kv]), c)


def session_features(spark: SparkSession, d: str) -> DataFrame:
    """The 22 features of a session, in a fixed order: length, counts and shares of moves, failures at the end, shape, words of the agent."""
    ev = written(_events(spark, d).select("session", "i", "kind", "tool", "target", "text", "err", "denied"))
    moves = S.with_moves(ev).groupBy("session").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "move"))), lambda x: x["move"]), "").alias("m"))
    words = ev.groupBy("session").agg(F.count_if(F.col("kind") == "ask").alias("asks"), F.count_if(F.col("kind") == "say").alias("says"), *[F.coalesce(F.sum(F.when(F.col("kind") == "say", F.regexp_count("text", F.lit(p)))), F.lit(0)).alias(k) for k, p in FEATURE_WORDS.items()])
    n = lambda p, c="m": (F.length(c) - F.length(F.regexp_replace(c, p, ""))).cast("double")
    j = words.join(moves, "session", "left").withColumn("m", F.coalesce("m", F.lit(""))).withColumn("tail", F.expr("right(m, 6)"))
    size = F.greatest(F.lit(1), F.length("m"))
    one = lambda p: F.col("m").rlike(p).cast("double")
    f = [F.length("m").cast("double"), *[n(x) for x in "prchsdXD"], n("[XD]") / size, n("p") / size, n("c") / size, n("[XD]", "tail"), one("[XD][XD]$"), one("c[^XD]*$"), one("s"), F.when(F.instr("m", "c") > 0, F.instr("m", "c") - 1).otherwise(F.length("m")).cast("double"), F.regexp_count("m", F.lit("c[^c]*h")).cast("double"), F.col("asks").cast("double"), *[F.col(k).cast("double") for k in FEATURE_WORDS]]
    return j.select("session", F.array(*f).alias("features"))


def wall_advice(spark: SparkSession, d: str) -> DataFrame:
    """What each wall is a matter of, what to do about it, how it is put, and its slug."""
    w = wall_rollup(spark, d)
    effect = F.concat(F.col("calls").cast("string"), F.lit(" calls in "), F.col("sessions").cast("string"), F.when(F.col("sessions") == 1, " session").otherwise(" sessions"))
    slug = F.regexp_replace(F.regexp_replace(F.lower("sig"), "[^a-z0-9]+", "-"), "^-|-$", "")
    return w.select("sig", F.coalesce(_map({k: v[0] for k, v in ADVICE.items()}, F.col("sig")), F.lit("unnamed")).alias("kind"), _map({k: v[1] for k, v in ADVICE.items()}, F.col("sig")).alias("advice"), effect.alias("effect"), slug.alias("slug"))


def headline_cascade(spark: SparkSession, d: str) -> DataFrame:
    """The one thing to say first: a wall met by five sessions and a fifth of all, else work left unchecked, else changes of course, else a wall met by three; nothing otherwise."""
    w = wall_rollup(spark, d)
    top = w.orderBy(F.desc("sessions"), F.desc("calls"), "sig").limit(1).select(F.col("sig"), F.col("sessions").alias("met"))
    o = written(session_outline(spark, d))
    n = o.agg(F.count("*").alias("n"), F.count_if(F.col("moves").contains("c") & ~F.col("moves").rlike("[hs]")).alias("unchecked"))
    b = PL.piece_backtracks(spark, d).agg(F.count("*").alias("backs"))
    j = n.join(b).join(top, F.lit(True), "left")  # one row each
    what = (
        F.when((F.col("met") >= 5) & (F.col("met") >= 0.2 * F.col("n")), F.concat(F.lit("wall:"), F.col("sig"))).when((F.col("unchecked") >= 10) & (F.col("unchecked") >= 0.3 * F.col("n")), "unchecked")
        .when(F.col("backs") >= 10, "backtracks").when(F.col("met") >= 3, F.concat(F.lit("wall:"), F.col("sig")))
    )
    return j.select(what.alias("headline"), F.coalesce("met", F.lit(0)).alias("met"), "unchecked", "backs").where("headline is not null")


def codebook_counts(spark: SparkSession, d: str) -> DataFrame:
    """Statuses of sessions in the words of the label form."""
    return status_cascade(spark, d).groupBy(F.coalesce(_map(CODEBOOK, F.col("status")), F.lit("unclear")).alias("label")).agg(F.count("*").alias("n"))


def session_digests(spark: SparkSession, d: str) -> DataFrame:
    """A text digest of every session: first ask, moves (head and tail), last message."""
    ev = _events(spark, d)
    t = ev.groupBy("session").agg(F.min_by("text", F.when(F.col("kind") == "ask", F.col("i"))).alias("a"), F.max_by("text", F.when(F.col("kind") == "say", F.col("i"))).alias("z"))
    j = t.join(session_outline(spark, d), "session", "left")
    cut = F.when(F.length("moves") > 80, F.concat(F.substring("moves", 1, 40), F.lit(".."), F.expr("right(moves, 40)"))).otherwise(F.col("moves"))
    return j.select("session", F.concat_ws(" | ", F.concat(F.lit("asked: "), F.substring("a", 1, 80)), F.concat(F.lit("moves: "), cut), F.concat(F.lit("said: "), F.substring("z", 1, 80))).alias("digest"))


def fix_targets(spark: SparkSession, d: str) -> DataFrame:
    """Where the rule against a wall belongs: the instruction file of the repository that met it most, then the common one."""
    hit = S.wall_hits(_events(spark, d)).where("named").select("session", "sig").distinct()
    n = hit.join(L.sessions(table(spark, d, "claude")).where("cwd is not null"), "session").groupBy("sig", "cwd").agg(F.count("*").alias("n"))
    top = n.withColumn("k", F.row_number().over(W.partitionBy("sig").orderBy(F.desc("n"), "cwd"))).where("k = 1")
    own = top.select("sig", F.lit(1).cast("bigint").alias("rank"), F.concat("cwd", F.lit("/AGENTS.md")).alias("target"))
    return own.unionByName(top.select("sig", F.lit(2).cast("bigint").alias("rank"), F.lit("~/AGENTS.md").alias("target")))


def session_list(spark: SparkSession, d: str, contains: str = "export", status: str = "outcome") -> DataFrame:
    """Sessions with a status whose asks contain a word, newest first; the limit is the feature."""
    ev = _events(spark, d)
    s = ev.groupBy("session").agg(F.min("ts").alias("start"), F.max((F.col("kind") == "ask") & F.contains(F.lower("text"), F.lit(contains))).alias("has"))
    return s.where("has").join(status_cascade(spark, d).where(F.col("status") == status), "session").orderBy(F.desc("start"), "session").limit(20).select("session", "start", "status")


def labels_on_test(spark: SparkSession, d: str) -> DataFrame:
    """Labels that count in an evaluation: of the sealed split, of true threads, no repeats; per labeler."""
    from weftline.operators.measures import hash_split

    g = table(spark, d, "gold_labels").where("item_key is not null and labeler is not null and not coalesce(is_repeat, false)")
    g = g.withColumn("split", hash_split(F.substring_index("item_key", ":", 1), "weft", 0.35)).where((F.col("split") == "test") & (F.coalesce(F.lower(F.trim("boundary")), F.lit("")) != "not_a_thread"))
    return g.groupBy("labeler").agg(F.count("*").alias("n"), F.count_distinct("item_key").alias("items"))


def bench_tasks(spark: SparkSession, d: str) -> DataFrame:
    """Tasks to measure agents by: the newest sessions with a named wall, one per first ask; the limit is the feature."""
    ev = written(_events(spark, d))
    walled = S.wall_hits(ev).where("named").select("session").distinct()
    first = ev.groupBy("session").agg(F.min("ts").alias("start"), F.min_by("text", F.when(F.col("kind") == "ask", F.col("i"))).alias("ask")).where("ask is not null").join(walled, "session")
    once = first.withColumn("k", F.row_number().over(W.partitionBy(F.lower(F.trim("ask"))).orderBy(F.desc("start"), "session"))).where("k = 1")
    return once.orderBy(F.desc("start"), "session").limit(12).select("session", "ask")


def label_precedence(spark: SparkSession, d: str) -> DataFrame:
    """One status per item by rank of its source: a blind label beats one that saw the suggestion, later beats earlier."""
    g = table(spark, d, "gold_labels").where("status is not null and item_key is not null")
    order = F.struct(F.when(F.col("is_blind"), 2).otherwise(1).alias("rank"), "labeled_at", "label_id")
    return g.groupBy("item_key").agg(F.lower(F.trim(F.max_by("status", order))).alias("status"), F.max(F.when(F.col("is_blind"), 2).otherwise(1)).cast("bigint").alias("rank"))


def second_reads(spark: SparkSession, d: str) -> DataFrame:
    """Readings of messages by text hash: how many messages share one reading, so that a second reader is asked once."""
    m = _events(spark, d).where("kind = 'say'").select(F.substring(F.sha2("text", 256), 1, 16).alias("key"), "act")
    return m.groupBy("key").agg(F.count("*").alias("messages"), F.min("act").alias("act"))


def governed_by(spark: SparkSession, d: str) -> DataFrame:
    """The standing rule that governs each piece: the last one stated before it in its session."""
    p = written(pieces.with_piece(written(_events(spark, d))))
    start = p.groupBy("session", "piece_id").agg(F.min("i").alias("first_i"))
    rule = S.judgments(p.select(*E.COLUMNS)).where("signal = 'explicit_rule'").select("session", F.col("i").alias("at"), "signal_id")
    both = start.select("session", F.col("first_i").alias("at"), "piece_id", F.lit(None).cast("string").alias("signal_id"), F.lit(0).alias("o")).unionByName(rule.select("session", "at", F.lit(None).cast("string").alias("piece_id"), "signal_id", F.lit(1).alias("o")))
    from weftline.operators.stage import running

    r = running(both, "session", "at", ["at", "o"], lasts={"rule": F.col("signal_id")}, before=True)
    return r.where("piece_id is not null").select("piece_id", "rule")


def signals_in_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The piece that owns each signal."""
    p = written(pieces.with_piece(written(_events(spark, d))))
    return S.judgments(p.select(*E.COLUMNS)).select("session", "i", "signal").join(p.select("session", "i", "piece_id"), ["session", "i"])


def repeated_asks(spark: SparkSession, d: str) -> DataFrame:
    """Asks that come again in other sessions, by their text without case, marks and paths."""
    key = F.trim(F.regexp_replace(F.regexp_replace(F.lower("text"), r"[^ ]*/[^ ]*", " "), "[^a-z]+", " "))
    a = _events(spark, d).where("kind = 'ask'").select("session", key.alias("key")).where("key <> ''")
    return a.groupBy("key").agg(F.count("*").alias("asks"), F.count_distinct("session").alias("sessions")).where("sessions > 1")


def trigger_histogram(spark: SparkSession, d: str) -> DataFrame:
    """What triggered the changes of course."""
    return PL.piece_backtracks(spark, d).groupBy("trigger").agg(F.count("*").alias("n"), F.count_distinct("session").alias("sessions"))


def bench_table(spark: SparkSession, d: str) -> DataFrame:
    """By model and permission mode: sessions, those that ran into a named wall, those without a call."""
    ev = written(_events(spark, d))
    hit = S.wall_hits(ev).where("named").select("session").distinct().withColumn("hit", F.lit(True))
    n = ev.groupBy("session").agg(F.count_if(F.col("kind") == "tool").alias("calls")).join(L.sessions(table(spark, d, "claude")).select("session", "model", "mode"), "session").join(hit, "session", "left")
    return n.groupBy("model", "mode").agg(F.count("*").alias("sessions"), F.count_if("hit").alias("walked_in"), F.count_if(F.col("calls") == 0).alias("unparsed"))


def blind_tally(spark: SparkSession, d: str) -> DataFrame:
    """Of items with labels blind and not: which side agrees with the majority, sides flipped by a seeded hash as in a blind reading."""
    v = table(spark, d, "gold_labels").where("status is not null and item_key is not null and labeler is not null and not coalesce(is_repeat, false)")
    side = v.groupBy("item_key", F.coalesce("is_blind", F.lit(False)).alias("blind")).agg(F.lower(F.trim(F.max_by("status", F.struct("labeled_at", "label_id")))).alias("status"))
    from weftline.plans.evaluation import majority

    a, b = side.where("blind").select("item_key", F.col("status").alias("x")), side.where("not blind").select("item_key", F.col("status").alias("y"))
    flip = F.substring(F.sha2(F.concat("item_key", F.lit("|42")), 256), 1, 1).isin(*"01234567")
    j = a.join(b, "item_key").join(majority(votes(spark, d)), "item_key")
    right = F.when((F.col("x") == F.col("gold")) & (F.col("y") != F.col("gold")), F.when(flip, "B").otherwise("A")).when((F.col("y") == F.col("gold")) & (F.col("x") != F.col("gold")), F.when(flip, "A").otherwise("B")).otherwise("same")
    return j.groupBy(right.alias("pick"), flip.alias("flipped")).agg(F.count("*").alias("n"))


def status_counts(spark: SparkSession, d: str) -> DataFrame:
    """Pieces by outcome and status, all three levels in one pass of grouping sets."""
    o = PL.piece_outcomes(spark, d)
    return o.groupingSets([[], [F.col("status")], [F.col("status"), F.col("outcome")]], F.col("status"), F.col("outcome")).agg(F.count("*").alias("n"), F.grouping_id().cast("bigint").alias("gid"))


def repeats_due(spark: SparkSession, d: str, every: int = 9) -> DataFrame:
    """Where a labeler is due a hidden repeat: nine labels or more since the last one."""
    g = table(spark, d, "gold_labels").where("labeler is not null and labeled_at is not null").select("labeler", "labeled_at", "label_id", F.coalesce("is_repeat", F.lit(False)).alias("rep"))
    w = W.partitionBy("labeler").orderBy("labeled_at", "label_id")
    g = g.withColumn("block", F.sum(F.col("rep").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    g = g.withColumn("since", F.row_number().over(W.partitionBy("labeler", "block").orderBy("labeled_at", "label_id")) - F.when(F.col("block") > 0, 1).otherwise(0))
    return g.groupBy("labeler").agg(F.count_if(F.col("since") >= every).alias("due"), F.count("*").alias("n"))


def act_context(spark: SparkSession, d: str) -> DataFrame:
    """What messages do, with the acts of the two messages before them."""
    m = S.with_acts(_events(spark, d))
    w = W.partitionBy("session").orderBy("i")
    c = m.select("act", F.lag("act", 1).over(w).alias("before"), F.lag("act", 2).over(w).alias("before2"))
    return c.groupBy("act", "before", "before2").agg(F.count("*").alias("n"))


def links_of_pieces(spark: SparkSession, d: str, most: int = 20) -> DataFrame:
    """The surest links of every piece, in either direction; the limit per piece is the feature."""
    lk = pieces.links(pieces.objects(_events(spark, d)))
    both = lk.select(F.col("a").alias("piece_id"), F.col("b").alias("other"), "confidence").unionByName(lk.select(F.col("b").alias("piece_id"), F.col("a").alias("other"), "confidence"))
    return both.withColumn("k", F.row_number().over(W.partitionBy("piece_id").orderBy(F.desc("confidence"), "other")).cast("bigint")).where(F.col("k") <= most)


def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    """An identity for every piece that outlives a re-cut: the hash of its session and opening event, with an epoch for equal openings."""
    p = written(pieces.with_piece(written(_events(spark, d))))
    o = p.groupBy("session", "piece").agg(F.min("i").alias("i"), F.min_by(F.concat_ws("|", "kind", F.coalesce("text", "target", F.lit(""))), "i").alias("opening"))
    key = F.substring(F.sha2(F.concat_ws("|", "session", "opening"), 256), 1, 12)
    e = o.withColumn("key", key).withColumn("epoch", F.row_number().over(W.partitionBy("session", "key").orderBy("i")) - 1)
    return e.select("session", "piece", F.concat_ws("~", "key", F.col("epoch").cast("string")).alias("stable_id"))


def clean_asks(spark: SparkSession, d: str, most: int = 120) -> DataFrame:
    """Asks without tags and wrappers, on one line, clipped with an ellipsis."""
    flat = F.trim(F.regexp_replace(F.regexp_replace("text", "</?[A-Za-z][^>]*>", " "), r"\s+", " "))
    return _events(spark, d).where("kind = 'ask'").select("session", "i", F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most - 1), F.lit("…"))).otherwise(flat).alias("ask"))


def noise(spark: SparkSession, d: str) -> DataFrame:
    """Texts of the person's side that the harness wrote, by how they begin."""
    b = table(spark, d, "claude").where("message.role = 'user'").select(F.explode("message.content").alias("b")).where("b.type = 'text' and b.text is not null")
    starts = ("Caveat:", "[Request interrupted", "[Usage limit reached", "<system-reminder", "<command-", "<local-command", "<environment_context", "[scheduled]")
    kind = F.coalesce(*[F.when(F.startswith("b.text", F.lit(s)), s) for s in starts], F.lit("person"))
    return b.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


NAMES = (
    session_features, wall_advice, headline_cascade, codebook_counts, session_digests, fix_targets, session_list, labels_on_test, bench_tasks, label_precedence, second_reads, governed_by, signals_in_pieces, repeated_asks, trigger_histogram,
    bench_table, blind_tally, status_counts, repeats_due, act_context, links_of_pieces, stable_ids, clean_asks, noise,
)
QUERIES = {f.__name__: f for f in NAMES}

_ADV = lambda k: "CASE sig " + " ".join(f"WHEN '{s}' THEN {_Q(v[k])}" for s, v in ADVICE.items()) + " END"
_cnt = lambda p, c="m": f"(length({c}) - length(regexp_replace({c}, '{p}', '', 'g')))::DOUBLE"
_is = lambda p: f"regexp_matches(m, '{p}')::INT::DOUBLE"
_SIGS = _SES_SQL["signals"].removesuffix("SELECT *, left(sha256(concat_ws('|', session, signal, CAST(i AS VARCHAR), text)), 16) AS signal_id FROM s4")
_BT = PL.SQL["piece_backtracks"]
_WR = _SES_SQL["wall_rollup"]
_JOINSIG = _PIECE + ", " + _SIGS[len(_WITH):].lstrip().lstrip(",") if _SIGS.startswith(_WITH) else ""
SQL = {
    "session_features": _OUT + f""", wd AS (SELECT session, count(*) FILTER (kind = 'ask') AS asks, {", ".join(f"coalesce(sum(len(regexp_extract_all(text, {_Q(p)}))) FILTER (kind = 'say'), 0) AS {k}" for k, p in FEATURE_WORDS.items())} FROM ev GROUP BY session),
        j AS (SELECT wd.*, coalesce(moves, '') AS m, right(coalesce(moves, ''), 6) AS tail FROM wd LEFT JOIN outline USING (session))
        SELECT session, [length(m)::DOUBLE, {", ".join(_cnt(x) for x in "prchsdXD")}, {_cnt("[XD]")} / greatest(1, length(m)), {_cnt("p")} / greatest(1, length(m)), {_cnt("c")} / greatest(1, length(m)), {_cnt("[XD]", "tail")}, {_is("[XD][XD]$")}, {_is("c[^XD]*$")}, {_is("s")}, CASE WHEN instr(m, 'c') > 0 THEN instr(m, 'c') - 1 ELSE length(m) END::DOUBLE, len(regexp_extract_all(m, 'c[^c]*h'))::DOUBLE, asks::DOUBLE, {", ".join(f"{k}::DOUBLE" for k in FEATURE_WORDS)}] AS features FROM j""",
    "wall_advice": f"SELECT sig, coalesce({_ADV(0)}, 'unnamed') AS kind, {_ADV(1)} AS advice, calls || ' calls in ' || sessions || CASE WHEN sessions = 1 THEN ' session' ELSE ' sessions' END AS effect, regexp_replace(regexp_replace(lower(sig), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM ({_WR})",
    "headline_cascade": f"""SELECT * FROM (SELECT CASE WHEN met >= 5 AND met >= 0.2 * n THEN 'wall:' || sig WHEN unchecked >= 10 AND unchecked >= 0.3 * n THEN 'unchecked' WHEN backs >= 10 THEN 'backtracks' WHEN met >= 3 THEN 'wall:' || sig END AS headline, coalesce(met, 0) AS met, unchecked, backs FROM
        (SELECT count(*) AS n, count(*) FILTER (contains(moves, 'c') AND NOT regexp_matches(moves, '[hs]')) AS unchecked FROM ({_SES_SQL["session_outline"]})) CROSS JOIN (SELECT count(*) AS backs FROM ({_BT})) LEFT JOIN (SELECT sig, sessions AS met FROM ({_WR}) ORDER BY sessions DESC, calls DESC, sig LIMIT 1) ON true) WHERE headline IS NOT NULL""",
    "codebook_counts": f"SELECT CASE status WHEN 'outcome' THEN 'done' WHEN 'abandoned' THEN 'dropped' WHEN 'open' THEN 'open' ELSE 'unclear' END AS label, count(*) AS n FROM ({_SES_SQL['status_cascade']}) GROUP BY 1",
    "session_digests": _OUT + ", t AS (SELECT session, arg_min(text, i) FILTER (kind = 'ask') AS a, arg_max(text, i) FILTER (kind = 'say') AS z FROM ev GROUP BY session) SELECT session, concat_ws(' | ', 'asked: ' || left(a, 80), 'moves: ' || CASE WHEN length(moves) > 80 THEN left(moves, 40) || '..' || right(moves, 40) ELSE moves END, 'said: ' || left(z, 80)) AS digest FROM t LEFT JOIN outline USING (session)",
    "fix_targets": _WITH + f", {_HITS}, {PL._SF}, n AS (SELECT sig, cwd, count(*) AS n FROM (SELECT DISTINCT session, sig FROM hits WHERE wall IS NOT NULL) JOIN sf USING (session) WHERE cwd IS NOT NULL GROUP BY ALL), t AS (SELECT sig, cwd FROM (SELECT *, row_number() OVER (PARTITION BY sig ORDER BY n DESC, cwd) AS k FROM n) WHERE k = 1) SELECT sig, 1::BIGINT AS rank, cwd || '/AGENTS.md' AS target FROM t UNION ALL SELECT sig, 2::BIGINT, '~/AGENTS.md' FROM t",
    "session_list": _WITH + f", s AS (SELECT session, min(ts) AS start, bool_or(kind = 'ask' AND contains(lower(text), 'export')) AS has FROM ev GROUP BY session) SELECT session, start, status FROM s JOIN ({_SES_SQL['status_cascade']}) USING (session) WHERE has AND status = 'outcome' ORDER BY start DESC, session LIMIT 20",
    "labels_on_test": "SELECT labeler, count(*) AS n, count(DISTINCT item_key) AS items FROM gold_labels WHERE item_key IS NOT NULL AND labeler IS NOT NULL AND NOT coalesce(is_repeat, false) AND coalesce(lower(trim(boundary)), '') <> 'not_a_thread' AND CAST('0x' || left(sha256(split_part(item_key, ':', 1) || '|weft'), 8) AS BIGINT) / 4294967296.0 < 0.35 GROUP BY labeler",
    "bench_tasks": _WITH + f", {_HITS}, f AS (SELECT session, min(ts) AS start, arg_min(text, i) FILTER (kind = 'ask') AS ask FROM ev GROUP BY session), o AS (SELECT * FROM f WHERE ask IS NOT NULL AND session IN (SELECT session FROM hits WHERE wall IS NOT NULL)) SELECT session, ask FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(ask)) ORDER BY start DESC, session) AS k FROM o) WHERE k = 1 ORDER BY start DESC, session LIMIT 12",
    "label_precedence": "SELECT item_key, lower(trim(arg_max(status, struct_pack(r := CASE WHEN is_blind THEN 2 ELSE 1 END, a := labeled_at, b := label_id)))) AS status, CAST(max(CASE WHEN is_blind THEN 2 ELSE 1 END) AS BIGINT) AS rank FROM gold_labels WHERE status IS NOT NULL AND item_key IS NOT NULL GROUP BY item_key",
    "second_reads": _WITH + f"SELECT left(sha256(text), 16) AS key, count(*) AS messages, min({PL._ACT}) AS act FROM ev WHERE kind = 'say' GROUP BY 1",
    "governed_by": _JOINSIG + ", rl AS (SELECT *, left(sha256(concat_ws('|', session, signal, CAST(i AS VARCHAR), text)), 16) AS signal_id FROM s4 WHERE signal = 'explicit_rule'), st AS (SELECT session, piece_id, min(i) AS first_i FROM pc GROUP BY ALL) SELECT st.piece_id, arg_max(rl.signal_id, rl.i) AS rule FROM st LEFT JOIN rl ON rl.session = st.session AND rl.i < st.first_i GROUP BY st.piece_id",
    "signals_in_pieces": _JOINSIG + " SELECT s4.session, s4.i, signal, piece_id FROM s4 JOIN pc ON pc.session = s4.session AND pc.i = s4.i",
    "repeated_asks": _WITH + "SELECT * FROM (SELECT key, count(*) AS asks, count(DISTINCT session) AS sessions FROM (SELECT session, trim(regexp_replace(regexp_replace(lower(text), '[^ ]*/[^ ]*', ' ', 'g'), '[^a-z]+', ' ', 'g')) AS key FROM ev WHERE kind = 'ask') WHERE key <> '' GROUP BY key) WHERE sessions > 1",
    "trigger_histogram": f"SELECT trigger, count(*) AS n, count(DISTINCT session) AS sessions FROM ({_BT}) GROUP BY trigger",
    "bench_table": _WITH + f", {_HITS}, {PL._SF}, n AS (SELECT session, count(*) FILTER (kind = 'tool') AS calls FROM ev GROUP BY session) SELECT model, mode, count(*) AS sessions, count(*) FILTER (n.session IN (SELECT session FROM hits WHERE wall IS NOT NULL)) AS walked_in, count(*) FILTER (calls = 0) AS unparsed FROM n JOIN sf USING (session) GROUP BY model, mode",
    "blind_tally": _V + """, sd AS (SELECT item_key, coalesce(is_blind, false) AS blind, lower(trim(arg_max(status, struct_pack(a := labeled_at, b := label_id)))) AS status FROM gold_labels WHERE status IS NOT NULL AND item_key IS NOT NULL AND labeler IS NOT NULL AND NOT coalesce(is_repeat, false) GROUP BY ALL),
        j AS (SELECT a.item_key, a.status AS x, b.status AS y, gold, left(sha256(a.item_key || '|42'), 1) IN ('0','1','2','3','4','5','6','7') AS flipped FROM sd a JOIN sd b USING (item_key) JOIN mj USING (item_key) WHERE a.blind AND NOT b.blind)
        SELECT CASE WHEN x = gold AND y <> gold THEN CASE WHEN flipped THEN 'B' ELSE 'A' END WHEN y = gold AND x <> gold THEN CASE WHEN flipped THEN 'A' ELSE 'B' END ELSE 'same' END AS pick, flipped, count(*) AS n FROM j GROUP BY ALL""",
    "status_counts": f"SELECT status, outcome, count(*) AS n, grouping(status, outcome) AS gid FROM ({PL.SQL['piece_outcomes']}) GROUP BY GROUPING SETS ((), (status), (status, outcome))",
    "repeats_due": "WITH g AS (SELECT labeler, labeled_at, label_id, sum(CAST(coalesce(is_repeat, false) AS INT)) OVER (PARTITION BY labeler ORDER BY labeled_at, label_id ROWS UNBOUNDED PRECEDING) AS block FROM gold_labels WHERE labeler IS NOT NULL AND labeled_at IS NOT NULL), h AS (SELECT labeler, row_number() OVER (PARTITION BY labeler, block ORDER BY labeled_at, label_id) - CASE WHEN block > 0 THEN 1 ELSE 0 END AS since FROM g) SELECT labeler, count(*) FILTER (since >= 9) AS due, count(*) AS n FROM h GROUP BY labeler",
    "act_context": f"SELECT act, before, before2, count(*) AS n FROM (SELECT act, lag(act, 1) OVER w AS before, lag(act, 2) OVER w AS before2 FROM ({_SES_SQL['message_acts']}) WINDOW w AS (PARTITION BY session ORDER BY i)) GROUP BY ALL",
    "links_of_pieces": _LINK + "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY piece_id ORDER BY confidence DESC, other) AS k FROM (SELECT a AS piece_id, b AS other, confidence FROM lk UNION ALL SELECT b, a, confidence FROM lk)) WHERE k <= 20",
    "stable_ids": _PIECE + ", o AS (SELECT session, piece, min(i) AS i, arg_min(concat_ws('|', kind, coalesce(text, target, '')), i) AS opening FROM pc GROUP BY ALL), e AS (SELECT *, left(sha256(concat_ws('|', session, opening)), 12) AS key FROM o) SELECT session, piece, key || '~' || (row_number() OVER (PARTITION BY session, key ORDER BY i) - 1) AS stable_id FROM e",
    "clean_asks": _WITH + r"SELECT session, i, CASE WHEN length(f) > 120 THEN left(f, 119) || '…' ELSE f END AS ask FROM (SELECT session, i, trim(regexp_replace(regexp_replace(text, '</?[A-Za-z][^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS f FROM ev WHERE kind = 'ask')",
    "noise": "SELECT CASE " + " ".join(f"WHEN starts_with(b.text, '{s}') THEN '{s}'" for s in ("Caveat:", "[Request interrupted", "[Usage limit reached", "<system-reminder", "<command-", "<local-command", "<environment_context", "[scheduled]")) + " ELSE 'person' END AS kind, count(*) AS n FROM (SELECT unnest(message.content) AS b FROM claude WHERE message.role = 'user') WHERE b.type = 'text' AND b.text IS NOT NULL GROUP BY 1",
}
