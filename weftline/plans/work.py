"""Queries over pieces of work: threads, goals, criteria, links between pieces, workstreams, text statistics, search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weftline.functions import phrases as P
from weftline.operators import events as E
from weftline.operators import graph, measures, pieces
from weftline.operators import steps as S
from weftline.operators import threads as T
from weftline.operators.stage import written
from weftline.plans.sessions import _WITH
from weftline.sources.tables import table


def _events(spark: SparkSession, d: str) -> DataFrame:
    return E.chat_events(table(spark, d, "claude"))


def threads(spark: SparkSession, d: str) -> DataFrame:
    return T.threads(_events(spark, d))


def thread_spans(spark: SparkSession, d: str) -> DataFrame:
    return threads(spark, d).select("session", "thread", "root", F.explode("spans").alias("s")).select("session", "thread", "root", "s.a", "s.b")


def _goals(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    ev = written(_events(spark, d))  # the machine and the steps read the same events
    th = written(T.threads(ev))
    return T.goal_steps(ev, th), th


def goals(spark: SparkSession, d: str) -> DataFrame:
    return T.goal_outcomes(_goals(spark, d)[0])


def goal_backtracks(spark: SparkSession, d: str) -> DataFrame:
    return T.backtracks(_goals(spark, d)[0])


def receipts(spark: SparkSession, d: str) -> DataFrame:
    """One nested document per goal: intent, actions, artifacts, outcome, verification, detours, and a hash of its content."""
    steps, th = _goals(spark, d)
    steps = written(steps)
    root = th.where("thread = root").select("session", "root", "title", "origin")
    acts = steps.where("kind = 'tool'").groupBy("session", "root").agg(
        F.array_sort(F.collect_list(F.struct("i", "action", "result", "target"))).alias("actions"),
        F.array_sort(F.collect_set(F.when(F.col("action") == "edit", F.col("target")))).alias("files"), F.array_sort(F.collect_set("pr")).alias("prs"),
    )
    checks = F.filter("actions", lambda a: a["action"].isin("test", "typecheck", "lint", "build"))
    back = T.backtracks(steps).groupBy("session", "root").agg(F.array_sort(F.collect_list(F.struct("i", "trigger"))).alias("detours"))
    doc = T.goal_outcomes(steps).join(root, ["session", "root"]).join(acts, ["session", "root"], "left").join(back, ["session", "root"], "left")
    verification = F.when(F.size(checks) <= 0, "unverified").when(F.forall(checks, lambda a: a["result"] == "pass"), "passed").when(F.exists(checks, lambda a: a["result"] == "pass"), "partial").when(F.forall(checks, lambda a: a["result"].isin("ok", "pending")), "inconclusive").otherwise("failed")
    doc = doc.withColumn("verification", F.coalesce(verification, F.lit("unverified"))).withColumn("receipt_id", F.concat_ws(":", F.lit("weft"), "session", "root"))
    from weftline.functions.text import head_tail

    doc = doc.withColumn("actions", head_tail(F.coalesce("actions", F.array().cast("array<struct<i:bigint,action:string,result:string,target:string>>")), 150, 150))
    body = F.to_json(F.struct("receipt_id", "title", "origin", "outcome", "status", "verification", "actions", "files", "prs", "detours"))
    return doc.select("receipt_id", "session", "root", "title", "origin", "outcome", "status", "confidence", "verification", "actions", "files", "prs", "detours", F.sha2(body, 256).alias("content_hash"))


def overall_confidence(spark: SparkSession, d: str) -> DataFrame:
    """The least of the confidences that are there: outcome, boundary (detours make it less sure), detours found."""
    steps, th = _goals(spark, d)
    detours = th.where("thread <> root").groupBy("session", "root").agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "found").alias("found"))
    out = T.goal_outcomes(steps).join(detours, ["session", "root"], "left")
    boundary = F.when(F.col("n").isNull(), 0.9).when(F.col("found") == 0, 0.85).otherwise(0.7)
    return out.select("session", "root", F.array_min(F.array_compact(F.array("confidence", boundary))).alias("confidence"))


def review_queue(spark: SparkSession, d: str) -> DataFrame:
    """What a person should look at first: unsure outcomes and unverified changes of substantial goals, by value; the limit is the feature."""
    g = goals(spark, d).where("n_steps >= 5")
    a = g.where("confidence < 0.6").select("session", "root", F.lit("outcome").alias("question"), ((1 - F.col("confidence")) * (1 + F.col("n_steps") / 50)).alias("value"))
    b = g.where("checked_after_change = false").select("session", "root", F.lit("unchecked").alias("question"), F.lit(0.6).alias("value"))
    return a.unionByName(b).orderBy(F.desc("value"), "session", "root", "question").limit(50)


def area_segments(spark: SparkSession, d: str) -> DataFrame:
    """How many files and pieces touch each area: the directory part of a file behind ``src``."""
    o = pieces.objects(_events(spark, d)).where("type = 'file'")
    return o.groupBy(F.regexp_extract("id", r"^src/([a-z0-9_-]+)/", 1).alias("area")).agg(F.count_distinct("id").alias("files"), F.count_distinct("piece_id").alias("pieces"))


def objects_touched(spark: SparkSession, d: str) -> DataFrame:
    return pieces.objects(_events(spark, d)).select("piece_id", "type", "id")


def rare_objects(spark: SparkSession, d: str) -> DataFrame:
    return pieces.rare_objects(pieces.objects(_events(spark, d))).select("piece_id", "type", "id", "n")


def piece_links(spark: SparkSession, d: str) -> DataFrame:
    return pieces.links(pieces.objects(_events(spark, d)))


def workstreams(spark: SparkSession, d: str) -> DataFrame:
    """Pieces joined by sure links: one row per component with its size, sessions, span and weakest link."""
    objs = written(pieces.objects(_events(spark, d)))
    sure = written(pieces.links(objs).where(F.col("confidence") >= pieces.JOIN))
    c = graph.connected_components(sure)
    start = objs.select("piece_id", "session", "start").distinct()
    weak = sure.join(c, F.col("a") == F.col("node")).groupBy("component").agg(F.min("confidence").alias("weakest"), F.count("*").alias("links"))
    member = c.join(start, F.col("node") == F.col("piece_id")).groupBy("component").agg(F.count_distinct("node").alias("pieces"), F.count_distinct("session").alias("sessions"), F.min("start").alias("first_at"), F.max("start").alias("last_at"))
    return member.join(weak, "component").select("component", "pieces", "sessions", "links", "weakest", "first_at", "last_at")


def best_parents(spark: SparkSession, d: str) -> DataFrame:
    """The surest earlier piece that each piece follows."""
    w = W.partitionBy("b").orderBy(F.desc("confidence"), "a")
    return piece_links(spark, d).withColumn("k", F.row_number().over(w)).where("k = 1").select(F.col("b").alias("piece_id"), F.col("a").alias("parent"), "relationship", "confidence")


def _vectors(p: DataFrame) -> DataFrame:
    """(doc, term, x): term weights of the asks of pieces, of length one."""
    v = written(pieces.term_weights(p.select(F.col("piece_id").alias("doc"), F.col("ask").alias("text"))))
    norm = v.groupBy("doc").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    return v.join(norm, "doc").select("doc", "term", (F.col("weight") / F.col("norm")).alias("x"))


def _cosines(pairs: DataFrame, v: DataFrame) -> DataFrame:
    """``pairs`` (a, b, ...) with s, the cosine of their asks."""
    dot = pairs.select("a", "b").distinct().join(v.select(F.col("doc").alias("a"), "term", "x"), "a").join(v.select(F.col("doc").alias("b"), "term", F.col("x").alias("y")), ["b", "term"]).groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("s"))
    return pairs.join(dot, ["a", "b"], "left").withColumn("s", F.coalesce("s", F.lit(0.0)))


# Asks that take up what was before, and asks that say they continue other work.
REFERS = P.opening("yes; yep; ok; okay; do it; go; go ahead; continue; proceed; ship it; merge; merge it; next; keep going; and; also; now")
CONTINUES = P.words("continued from a previous conversation; continue where; continue from; continue the; continue with; continue working; picking up where; picking up from; picking up the; pick up where; pick up from; pick up the; resume; carry on; follow up on; follow-up on; follow up to; follow-up to; as discussed earlier; as discussed before; as planned earlier; as planned before; last session; previous session; yesterday's; since last week; again")


def continuation_links(events: DataFrame, facts: DataFrame) -> DataFrame:
    """(a, b, relationship, confidence): asks that take up an earlier piece.

    The piece before in the session, for an ask that is short or refers back (0.8), or that is similar (0.6 and more by
    its cosine). For an ask that says it continues earlier work, the most similar piece of another session of the
    repository in the seven days before, a day's nearness counting a tenth: 0.78, or 0.62 if it is hardly similar.
    """
    p = written(pieces.pieces(events).where("ask is not null").join(facts.select("session", "repo"), "session", "left").select("session", "piece", "piece_id", "start", "ask", "repo"))
    v = _vectors(p)
    before = p.withColumn("a", F.lag("piece_id").over(W.partitionBy("session").orderBy("piece"))).where("a is not null")
    near = _cosines(before.select("a", F.col("piece_id").alias("b"), "ask"), v)
    refers = F.col("ask").rlike(REFERS) | (F.length("ask") < 60)
    same = near.where(refers | (F.col("s") >= 0.3)).select("a", "b", F.when(refers, 0.8).otherwise(0.6 + F.least(F.lit(0.25), F.col("s") / 2)).alias("confidence"))
    say = p.where(F.col("ask").rlike(CONTINUES) & F.col("repo").isNotNull()).select(F.col("piece_id").alias("b"), F.col("session").alias("sb"), F.col("start").alias("tb"), "repo")
    week = F.floor(F.unix_timestamp("tb") / 604800)
    say = say.withColumn("week", F.explode(F.array(week - 1, week)))
    earlier = p.where("repo is not null").select(F.col("piece_id").alias("a"), F.col("session").alias("sa"), F.col("start").alias("ta"), "repo", F.floor(F.unix_timestamp("start") / 604800).alias("week"))
    gap = F.unix_timestamp("tb") - F.unix_timestamp("ta")
    pair = say.join(earlier, ["repo", "week"]).where((F.col("sa") != F.col("sb")) & (gap > 0) & (gap < 7 * 86400))
    scored = _cosines(pair.select("a", "b", "ta", gap.alias("gap")), v).withColumn("s", F.round(F.col("s") + F.when(F.col("gap") < 86400, 0.1).otherwise(0.0), 9)).where("s > 0")
    best = scored.groupBy("b").agg(F.max(F.struct("s", "ta", "a")).alias("m"))
    cross = best.select(F.col("m.a").alias("a"), "b", F.when(F.col("m.s") >= 0.25, 0.78).otherwise(0.62).alias("confidence"))
    return same.unionByName(cross).select("a", "b", F.lit("continues").alias("relationship"), "confidence")


def continuations(spark: SparkSession, d: str) -> DataFrame:
    """Pieces whose ask takes up an earlier piece, of their session or of another."""
    claude = table(spark, d, "claude")
    from weftline.operators.ledger import sessions

    return continuation_links(E.chat_events(claude), sessions(claude)).select("a", "b", F.round("confidence", 6).alias("confidence"))


def _decisions(lk: DataFrame) -> DataFrame:
    """Stands for a person's decisions: pairs by a hash of their names, an eighth apart and an eighth the same effort."""
    h = F.substring(F.sha2(F.concat_ws("|", "a", "b"), 256), 1, 1)
    return lk.select("a", "b", F.when(h.isin("0", "1"), "unrelated").when(h.isin("2", "3"), "same_effort").alias("decision")).where("decision is not null").distinct()


def decided_links(spark: SparkSession, d: str) -> DataFrame:
    """The links of pieces after a person's decisions."""
    lk = written(pieces.links(pieces.objects(_events(spark, d))))
    return pieces.merged_links(lk.select("a", "b", "relationship", "confidence"), _decisions(lk))


def top_terms(spark: SparkSession, d: str) -> DataFrame:
    """The three most telling terms of each session's asks."""
    docs = _events(spark, d).where("kind = 'ask'").groupBy(F.col("session").alias("doc")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda x: x["text"]), " ").alias("text"))
    w = W.partitionBy("doc").orderBy(F.desc("weight"), "term")
    return pieces.term_weights(docs).withColumn("k", F.row_number().over(w)).where("k <= 3").select("doc", "term", "tf", "df")


def filter_goals(spark: SparkSession, d: str, query: str = "outcome:shipped conf:>=0.5") -> DataFrame:
    filters, _ = pieces.parse_query(query)
    return pieces.where_query(goals(spark, d), filters).select("session", "root", "outcome", "confidence")


def positional_zip(spark: SparkSession, d: str) -> DataFrame:
    """The n-th call of a session beside its n-th result, joined by ordinal."""
    claude = table(spark, d, "claude")
    rec = E.distinct_records(claude).select("row_id", F.col("sessionId").alias("session"), F.posexplode("message.content").alias("pos", "b"))
    w = W.partitionBy("session").orderBy("row_id", "pos")
    calls = rec.where(F.col("b.type") == "tool_use").select("session", F.row_number().over(w).alias("n"), F.col("b.id").alias("call_id"))
    res = rec.where(F.col("b.type") == "tool_result").select("session", F.row_number().over(w).alias("n"), F.col("b.tool_use_id").alias("result_id"))
    z = calls.join(res, ["session", "n"], "full")
    return z.groupBy("session").agg(F.count("*").alias("pairs"), F.count_if(F.col("call_id") == F.col("result_id")).alias("same"))


def lane_packing(spark: SparkSession, d: str) -> DataFrame:
    """Sub-rows for the threads of a session, so that no two in a row overlap."""
    t = threads(spark, d).select(F.col("session").alias("grp"), F.col("thread"), F.element_at("spans", 1)["a"].alias("a"), F.element_at("spans", -1)["b"].alias("b")).where("a is not null")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return t.repartition(n, "grp").sortWithinPartitions("grp", "a", "thread").mapInPandas(measures.pack_lanes, "grp string, thread int, a bigint, b bigint, lane bigint")


def upload_bins(spark: SparkSession, d: str, most: int = 200) -> DataFrame:
    """Sessions of one repository packed in order into bins of at most ``most`` calls."""
    calls = _events(spark, d).where("kind = 'tool'").groupBy("session").agg(F.count("*").alias("size"))
    repo = table(spark, d, "claude").where("sessionId is not null and cwd is not null").groupBy(F.col("sessionId").alias("session")).agg(F.min("cwd").alias("grp"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = calls.join(repo, "session").select("grp", "session", "size")
    return rows.repartition(n, "grp").sortWithinPartitions("grp", "session").mapInPandas(lambda it: measures.pack_bins(it, most), "grp string, session string, size bigint, bin bigint")


NAMES = (
    threads, thread_spans, goals, goal_backtracks, receipts, overall_confidence, review_queue, area_segments, objects_touched, rare_objects, piece_links, workstreams, best_parents,
    continuations, decided_links, top_terms, filter_goals, positional_zip, lane_packing, upload_bins,
)
QUERIES = {f.__name__: f for f in NAMES}

_Q = lambda s: "'" + s.replace("'", "''") + "'"
_PIECE = _WITH + f""", pc AS (SELECT *, session || ':' || piece AS piece_id FROM (SELECT *, CAST(sum(CASE WHEN kind = 'ask' AND NOT regexp_matches(text, '{E.CONTINUE}') THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY i) AS BIGINT) AS piece FROM ev)),
 pieces AS (SELECT session, piece, piece_id, min(ts) AS start, arg_min(text, i) FILTER (kind = 'ask' AND NOT regexp_matches(text, '{E.CONTINUE}')) AS ask FROM pc GROUP BY session, piece, piece_id)"""
_all = lambda rel, c, p: f"SELECT piece_id, session, unnest(regexp_extract_all({c}, {_Q(p)}, 1)) AS id FROM {rel}"
_OBJ = _PIECE + f""", calls AS (SELECT *, CASE WHEN kind = 'tool' THEN nullif(regexp_extract(concat_ws(' ', target, CASE WHEN NOT err THEN out END), '(?:pull/|PR #|#)([0-9]{{1,6}})', 1), '') END AS named_pr FROM pc WHERE kind = 'tool'), asks AS (SELECT piece_id, session, text FROM pc WHERE kind = 'ask'), said AS (SELECT * FROM asks UNION ALL SELECT piece_id, session, target FROM calls),
 npr AS (SELECT DISTINCT * FROM ({_all("said", "text", pieces.NAMED_PR)})), ob0 AS (
 SELECT piece_id, session, 'file' AS type, target AS id, false AS produced FROM calls WHERE regexp_matches(target, {_Q(pieces.FILE)}) AND NOT regexp_matches(target, {_Q(pieces.NO_FILES)}) UNION ALL
 SELECT piece_id, session, 'pr', id, false FROM npr WHERE piece_id IN (SELECT piece_id FROM npr GROUP BY piece_id HAVING count(*) <= {pieces.MOST_NAMED}) UNION ALL
 SELECT piece_id, session, 'pr', named_pr, true FROM calls WHERE named_pr IS NOT NULL AND regexp_matches(lower(target), 'gh pr create|git push') UNION ALL
 SELECT piece_id, session, 'branch', id, false FROM ({_all("calls", "target", pieces.BRANCH)}) WHERE id NOT IN ({", ".join(map(_Q, pieces.COMMON_BRANCHES))}) UNION ALL
 SELECT piece_id, session, 'ticket', id, false FROM ({_all("asks", "text", pieces.NAMED_TICKET)}) WHERE NOT regexp_matches(id, {_Q(pieces.NO_TICKETS)}) UNION ALL
 SELECT piece_id, session, 'ticket', target, false FROM calls WHERE regexp_matches(target, {_Q(pieces.TICKET)}) UNION ALL
 SELECT piece_id, session, 'id', id, false FROM ({_all("asks", "lower(text)", pieces.NAMED_ID)})),
 ob AS (SELECT o.*, p.start FROM (SELECT piece_id, session, type, id, bool_or(produced) AS produced FROM ob0 GROUP BY ALL) o JOIN pieces p USING (piece_id)),
 rare AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY type, id) AS n FROM ob) WHERE n > 1 AND n <= CASE type WHEN 'file' THEN 6 ELSE 25 END)"""
_LINK = _OBJ + """, pr0 AS (SELECT *, lag(piece_id) OVER w AS a, lag(start) OVER w AS before, type = 'pr' AND (produced OR lag(produced) OVER w) AS made FROM rare WINDOW w AS (PARTITION BY type, id ORDER BY start, piece_id)),
 e0 AS (SELECT a, piece_id AS b, type, max(CASE WHEN made THEN 0.92::DOUBLE WHEN type = 'pr' THEN 0.74::DOUBLE WHEN type = 'file' THEN 0.55::DOUBLE + 0.25::DOUBLE / n WHEN type = 'id' THEN 0.9::DOUBLE ELSE 0.85::DOUBLE END) AS c FROM pr0
  WHERE a IS NOT NULL AND epoch(date_trunc('second', start)) - epoch(date_trunc('second', before)) < CASE WHEN made THEN 10 WHEN type = 'file' THEN 21 ELSE 4 END * 86400 GROUP BY ALL),
 sh AS (SELECT e.a, e.b, count(*) AS shared FROM e0 e JOIN rare x ON x.type = 'file' AND x.piece_id = e.a JOIN rare y ON y.type = 'file' AND y.piece_id = e.b AND y.id = x.id WHERE e.type = 'file' GROUP BY ALL),
 sl AS (SELECT a, b, 'same_' || type AS relationship, CASE WHEN type = 'file' AND shared >= 2 THEN least(0.88::DOUBLE, 0.7::DOUBLE + 0.06::DOUBLE * shared) ELSE c END AS confidence FROM e0 LEFT JOIN sh USING (a, b)),
 lk AS (SELECT a, b, t.r AS relationship, t.c AS confidence, array_to_string(list_filter(l, lambda x: x <> t.r), ',') AS also FROM (SELECT a, b, max(struct_pack(c := confidence, r := relationship)) AS t, list_sort(list(DISTINCT relationship)) AS l FROM sl GROUP BY a, b))"""
_TOK = lambda c: f"list_filter(list_transform(string_split(trim(regexp_replace(regexp_replace(lower({c}), 'https?://[^ ]+', ' ', 'g'), '[^a-z0-9#._/-]+', ' ', 'g')), ' '), lambda w: regexp_replace(w, '^[._/-]+|[._/-]+$', '', 'g')), lambda w: length(w) > 2 AND NOT list_contains([{', '.join(_Q(w) for w in __import__('weftline.functions.text', fromlist=['STOPWORDS']).STOPWORDS)}], w) AND NOT regexp_matches(w, '^[0-9]+$'))"

SQL = {
    "area_segments": _OBJ + "SELECT regexp_extract(id, '^src/([a-z0-9_-]+)/', 1) AS area, count(DISTINCT id) AS files, count(DISTINCT piece_id) AS pieces FROM ob WHERE type = 'file' GROUP BY 1",
    "objects_touched": _OBJ + "SELECT piece_id, type, id FROM ob",
    "rare_objects": _OBJ + "SELECT piece_id, type, id, n FROM rare",
    "piece_links": _LINK + "SELECT * FROM lk",
    "decided_links": _LINK + """, dc AS (SELECT a, b, CASE WHEN h IN ('0', '1') THEN 'unrelated' WHEN h IN ('2', '3') THEN 'same_effort' END AS decision FROM (SELECT a, b, left(sha256(a || '|' || b), 1) AS h FROM lk)) SELECT a, b, CASE WHEN decision = 'same_effort' THEN 'confirmed' ELSE relationship END AS relationship, CASE WHEN decision = 'same_effort' THEN 1.0::DOUBLE ELSE confidence END AS confidence, '' AS also FROM lk JOIN dc USING (a, b) WHERE decision IS NULL OR decision <> 'unrelated'""",
    "best_parents": _LINK + "SELECT b AS piece_id, a AS parent, relationship, confidence FROM (SELECT *, row_number() OVER (PARTITION BY b ORDER BY confidence DESC, a) AS k FROM lk) WHERE k = 1",
    "workstreams": (_LINK + """, sure AS MATERIALIZED (SELECT * FROM lk WHERE confidence >= 0.7), ways AS MATERIALIZED (SELECT a AS node, b AS other FROM sure UNION SELECT b, a FROM sure),
        reach AS (SELECT node, node AS seen FROM ways UNION SELECT r.node, e.other FROM reach r JOIN ways e ON e.node = r.seen), comp AS MATERIALIZED (SELECT node, min(seen) AS component FROM reach GROUP BY node),
        st AS (SELECT DISTINCT piece_id, session, start FROM ob)
        SELECT m.component, m.pieces, m.sessions, w.links, w.weakest, m.first_at, m.last_at FROM
        (SELECT component, count(DISTINCT node) AS pieces, count(DISTINCT session) AS sessions, min(start) AS first_at, max(start) AS last_at FROM comp JOIN st ON st.piece_id = comp.node GROUP BY component) m JOIN
        (SELECT component, min(confidence) AS weakest, count(*) AS links FROM sure JOIN comp ON comp.node = sure.a GROUP BY component) w USING (component)""").replace("WITH\n", "WITH RECURSIVE\n", 1),
    "top_terms": _WITH + f", dc AS (SELECT session AS doc, string_agg(text, ' ' ORDER BY i) AS text FROM ev WHERE kind = 'ask' GROUP BY session), t AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest({_TOK('text')}) AS term FROM dc) GROUP BY doc, term), f AS (SELECT term, count(*) AS df FROM t GROUP BY term), v AS (SELECT doc, term, tf, df, (1 + ln(tf)) * ln(((SELECT count(*) FROM dc) + 1) / (df + 0.5)) AS weight FROM t JOIN f USING (term)) SELECT doc, term, tf, df FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY weight DESC, term) AS k FROM v) WHERE k <= 3",
    "continuations": _PIECE + f""", rp AS (SELECT session, nullif(regexp_extract(regexp_replace(regexp_replace(max(struct_pack(n := n, v := v)).v, '/\\.(claude|codex|cursor)/worktrees/[^/]+.*$', ''), '/worktrees/[^/]+$', ''), '([^/]*)$', 1), '') AS repo FROM (SELECT sessionId AS session, cwd AS v, count(*) AS n FROM claude WHERE sessionId IS NOT NULL AND cwd IS NOT NULL GROUP BY ALL) GROUP BY session),
        p AS (SELECT pieces.*, repo FROM pieces LEFT JOIN rp USING (session) WHERE ask IS NOT NULL), t AS (SELECT doc, term, count(*) AS tf FROM (SELECT piece_id AS doc, unnest({_TOK('ask')}) AS term FROM p) GROUP BY doc, term), f AS (SELECT term, count(*) AS df FROM t GROUP BY term),
        v0 AS (SELECT doc, term, (1 + ln(tf)) * ln(((SELECT count(*) FROM p) + 1) / (df + 0.5)) AS weight FROM t JOIN f USING (term)), v AS (SELECT doc, term, weight / sqrt(sum(weight * weight) OVER (PARTITION BY doc)) AS x FROM v0),
        bf AS (SELECT * FROM (SELECT piece_id AS b, ask, lag(piece_id) OVER (PARTITION BY session ORDER BY piece) AS a FROM p) WHERE a IS NOT NULL),
        xs AS (SELECT y.piece_id AS b, x.piece_id AS a, x.start AS ta, epoch(date_trunc('second', y.start)) - epoch(date_trunc('second', x.start)) AS gap FROM p y JOIN p x ON x.repo = y.repo AND x.session <> y.session WHERE regexp_matches(y.ask, {_Q(CONTINUES)}) AND epoch(date_trunc('second', y.start)) - epoch(date_trunc('second', x.start)) > 0 AND epoch(date_trunc('second', y.start)) - epoch(date_trunc('second', x.start)) < 604800),
        pr AS (SELECT a, b FROM bf UNION SELECT a, b FROM xs), co AS (SELECT pr.a, pr.b, sum(m.x * n.x) AS s FROM pr JOIN v m ON m.doc = pr.a JOIN v n ON n.doc = pr.b AND n.term = m.term GROUP BY ALL),
        sm AS (SELECT a, b, regexp_matches(ask, {_Q(REFERS)}) OR length(ask) < 60 AS refers, coalesce(s, 0) AS s FROM bf LEFT JOIN co USING (a, b)),
        bs AS (SELECT b, max(struct_pack(s := s, ta := ta, a := a)) AS m FROM (SELECT xs.*, round(coalesce(co.s, 0) + CASE WHEN gap < 86400 THEN 0.1 ELSE 0 END, 9) AS s FROM xs LEFT JOIN co USING (a, b)) WHERE s > 0 GROUP BY b)
        SELECT a, b, round(CASE WHEN refers THEN 0.8::DOUBLE ELSE 0.6::DOUBLE + least(0.25, s / 2) END, 6) AS confidence FROM sm WHERE refers OR s >= 0.3 UNION ALL SELECT m.a, b, CASE WHEN m.s >= 0.25 THEN 0.78::DOUBLE ELSE 0.62::DOUBLE END FROM bs""",
    "upload_bins": (_WITH + """, sz AS (SELECT session, count(*) AS size FROM ev WHERE kind = 'tool' GROUP BY session), rp AS (SELECT sessionId AS session, min(cwd) AS grp FROM claude WHERE sessionId IS NOT NULL AND cwd IS NOT NULL GROUP BY 1),
        r AS MATERIALIZED (SELECT grp, session, size, row_number() OVER (PARTITION BY grp ORDER BY session) AS k FROM sz JOIN rp USING (session)), w AS (SELECT grp, session, size, k, 0::BIGINT AS bin, size AS held FROM r WHERE k = 1 UNION ALL
        SELECT r.grp, r.session, r.size, r.k, CASE WHEN w.held + r.size > 200 THEN w.bin + 1 ELSE w.bin END, CASE WHEN w.held + r.size > 200 THEN r.size ELSE w.held + r.size END FROM w JOIN r ON r.grp = w.grp AND r.k = w.k + 1) SELECT grp, session, size, bin FROM w""").replace("WITH\n", "WITH RECURSIVE\n", 1),
    "positional_zip": _WITH + ", cl AS (SELECT session, row_number() OVER (PARTITION BY session ORDER BY row_id, pos) AS n, b.id AS call_id FROM block WHERE b.type = 'tool_use'), rs AS (SELECT session, row_number() OVER (PARTITION BY session ORDER BY row_id, pos) AS n, b.tool_use_id AS result_id FROM block WHERE b.type = 'tool_result') SELECT session, count(*) AS pairs, count(*) FILTER (call_id = result_id) AS same FROM cl FULL JOIN rs USING (session, n) GROUP BY session",
}
