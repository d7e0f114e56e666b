"""Queries that compare and evaluate: labels against consensus, before against after, sampling, files, snapshots, redaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weftline.functions.text import entropy
from weftline.operators import events as E
from weftline.operators import measures as M
from weftline.operators import steps as S
from weftline.operators.secrets import secrets_in
from weftline.plans.sessions import _MV, _WITH, session_counters
from weftline.sources.tables import table


def votes(spark: SparkSession, d: str) -> DataFrame:
    """The last status label of every labeler and item, repeats apart."""
    g = table(spark, d, "gold_labels").where("status is not null and item_key is not null and labeler is not null and not coalesce(is_repeat, false)")
    last = g.groupBy("item_key", "labeler").agg(F.max_by("status", F.struct("labeled_at", "label_id")).alias("status"))
    return last.withColumn("status", F.lower(F.trim("status")))


def majority(v: DataFrame) -> DataFrame:
    """(item_key, gold, n, agree): the word with most votes, at a tie the least; unanimity and split are read off n and agree."""
    c = v.groupBy("item_key", "status").agg(F.count("*").alias("agree"))
    n = v.groupBy("item_key").agg(F.count("*").alias("n"))
    w = W.partitionBy("item_key").orderBy(F.desc("agree"), "status")
    top = c.withColumn("k", F.row_number().over(w)).where("k = 1").select("item_key", F.col("status").alias("gold"), "agree")
    return top.join(n, "item_key")


def majority_vote(spark: SparkSession, d: str) -> DataFrame:
    return majority(votes(spark, d))


def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    v = votes(spark, d)
    return v.join(majority(v), "item_key").groupBy("gold", F.col("status").alias("pred")).agg(F.count("*").alias("n"))


def precision_recall(spark: SparkSession, d: str) -> DataFrame:
    """Per word: predicted, gold and right counts over all labelers against the majority."""
    c = confusion_matrix(spark, d)
    p = c.groupBy(F.col("pred").alias("word")).agg(F.sum("n").alias("predicted"), F.sum(F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0)).alias("right_n"))
    g = c.groupBy(F.col("gold").alias("word")).agg(F.sum("n").alias("gold_n"))
    j = p.join(g, "word", "full").fillna(0, ["predicted", "right_n", "gold_n"])
    return j.select("word", "predicted", "gold_n", "right_n", F.try_divide("right_n", "predicted").alias("precision"), F.try_divide("right_n", "gold_n").alias("recall"))


def self_consistency(spark: SparkSession, d: str) -> DataFrame:
    """Of the items that a labeler labelled again: how many got the same status."""
    g = table(spark, d, "gold_labels").where("status is not null and item_key is not null and labeler is not null")
    side = lambda rep: g.where(F.coalesce("is_repeat", F.lit(False)) == rep).groupBy("item_key", "labeler").agg(F.max_by(F.lower(F.trim("status")), F.struct("labeled_at", "label_id")).alias("first" if not rep else "again"))
    return side(False).join(side(True), ["item_key", "labeler"]).groupBy("labeler").agg(F.count("*").alias("n"), F.count_if(F.col("first") == F.col("again")).alias("same"))


def abstain_curve(spark: SparkSession, d: str) -> DataFrame:
    """Answer or abstain: coverage and accuracy of labels by how large the majority on their item is."""
    v = votes(spark, d)
    j = v.join(majority(v), "item_key").select((F.col("agree") / F.col("n")).alias("conf"), (F.col("status") == F.col("gold")).alias("ok"))
    return M.abstain_curve(j)


def span_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Jaccard of the sets of files that a session's first and second half touched: union, intersection, and their ratio."""
    m = S.with_moves(E.chat_events(table(spark, d, "claude"))).where("target <> ''").withColumn("half", F.ntile(2).over(W.partitionBy("session").orderBy("i")))
    s = m.groupBy("session").agg(F.collect_set(F.when(F.col("half") == 1, F.col("target"))).alias("x"), F.collect_set(F.when(F.col("half") == 2, F.col("target"))).alias("y"))
    return s.select("session", F.size(F.array_intersect("x", "y")).cast("bigint").alias("common"), F.size(F.array_union("x", "y")).cast("bigint").alias("all_n"), (F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y"))).alias("jaccard"))


def hash_split(spark: SparkSession, d: str) -> DataFrame:
    """The sealed split of every session by its hash."""
    s = table(spark, d, "claude").where("sessionId is not null").select(F.col("sessionId").alias("session")).distinct()
    return s.select("session", M.hash_split(F.col("session"), "weft", 0.35).alias("split"))


def round_robin_sample(spark: SparkSession, d: str) -> DataFrame:
    """Forty items, in turn from the strata of their first origin label; the sample is the feature."""
    g = table(spark, d, "gold_labels").where("origin is not null and item_key is not null")
    it = g.groupBy("item_key").agg(F.min_by(F.lower(F.trim("origin")), "label_id").alias("stratum"))
    return M.round_robin(it, "item_key", "stratum", 40).select("item_key", "stratum", F.col("turn").cast("bigint").alias("turn"))


def median_profile(spark: SparkSession, d: str) -> DataFrame:
    """Per repository: sessions, and the upper median of calls before the first change."""
    m = S.with_moves(E.chat_events(table(spark, d, "claude")))
    n = m.withColumn("k", F.row_number().over(W.partitionBy("session").orderBy("i")) - 1)
    first = n.where("lane = 'change'").groupBy("session").agg(F.min("k").alias("before"))
    repo = table(spark, d, "claude").where("sessionId is not null and cwd is not null").groupBy(F.col("sessionId").alias("session")).agg(F.min("cwd").alias("repo"))
    return first.join(repo, "session").groupBy("repo").agg(F.count("*").alias("sessions"), M.upper_median(F.col("before")).cast("bigint").alias("median_before"))


def _session_values(spark: SparkSession, d: str) -> DataFrame:
    ev = E.chat_events(table(spark, d, "claude"))
    c = session_counters(ev, S.with_moves(ev))
    repo = table(spark, d, "claude").where("sessionId is not null and cwd is not null").groupBy(F.col("sessionId").alias("session")).agg(F.min("cwd").alias("repo"), F.max_by("permissionMode", F.when(F.col("permissionMode").isNotNull(), F.col("row_id"))).alias("mode"))
    return c.join(repo, "session")


def adoptions(s: DataFrame) -> DataFrame:
    """(repo, at): when a rule was adopted in a repository. The log names no adoption, so the start of the session in the
    middle of each repository's stands for it; a table of adoptions takes its place where there is one."""
    w = W.partitionBy("repo").orderBy("start", "session")
    n = s.where("start is not null").withColumn("k", F.row_number().over(w)).withColumn("n", F.count("*").over(W.partitionBy("repo")))
    return n.where(F.col("k") == F.floor(F.col("n") / 2) + 1).select("repo", F.col("start").alias("at"))


def _usual(df: DataFrame, keys: list[str], c: str, name: str) -> DataFrame:
    """The most frequent value of ``c`` per key, at a tie the largest."""
    n = df.groupBy(*keys, c).agg(F.count("*").alias("_n"))
    return n.groupBy(*keys).agg(F.max_by(c, F.struct("_n", c)).alias(name))


def adoption_effect(spark: SparkSession, d: str) -> DataFrame:
    """Sessions that met a failure before and after a rule was adopted in their repository, in the mode that was usual
    among those that met one before; confounded if another mode is usual after and fewer than half of the sessions after compare."""
    s = _session_values(spark, d).withColumn("mode", F.coalesce("mode", F.lit("unknown")))
    j = s.join(adoptions(s), "repo").withColumn("after", F.col("start") >= F.col("at")).withColumn("hit", F.col("errs") > 0)
    before = j.where("not after")
    usual = _usual(before.where("hit"), ["repo"], "mode", "mode_hit").join(_usual(before, ["repo"], "mode", "mode_all"), "repo", "full").select("repo", F.coalesce("mode_hit", "mode_all").alias("usual"))
    late = _usual(j.where("after"), ["repo"], "mode", "mode_after")
    k = j.join(usual, "repo").withColumn("same", F.col("mode") == F.col("usual"))
    count = lambda c: F.count_if(c)
    g = k.groupBy("repo").agg(
        F.first("usual").alias("mode"), count(F.col("same") & ~F.col("after")).alias("n_before"), count(F.col("same") & ~F.col("after") & F.col("hit")).alias("hit_before"), count(F.col("same") & F.col("after")).alias("n_after"), count(F.col("same") & F.col("after") & F.col("hit")).alias("hit_after"), count(F.col("after")).alias("all_after"),
    ).join(late, "repo", "left")
    return g.select(
        "repo", "mode", "mode_after", "n_before", "hit_before", "n_after", "hit_after", F.try_divide("hit_before", "n_before").alias("before_rate"), F.try_divide("hit_after", "n_after").alias("after_rate"),
        ((F.col("all_after") > 0) & (F.col("mode_after") != F.col("mode")) & (F.col("n_after") < F.col("all_after") / 2)).alias("confounded"), ((F.col("n_before") >= 5) & (F.col("n_after") >= 5)).alias("enough"),
    )


def _experiment_sessions(spark: SparkSession, d: str, days: int = 21) -> DataFrame:
    """Sessions within ``days`` of an edit of their repository's instructions, by an interval join; in the mode that was usual before."""
    s = _session_values(spark, d).withColumn("mode", F.coalesce("mode", F.lit("unknown")))
    j = s.join(adoptions(s), "repo").withColumn("gap", F.unix_timestamp("start") - F.unix_timestamp("at")).where(F.abs("gap") < days * 86400).withColumn("after", F.col("gap") >= 0)
    return j.join(_usual(j.where("not after"), ["repo"], "mode", "usual"), "repo").where(F.col("mode") == F.col("usual"))


#: Measures of a session that an experiment compares, and whether less is better.
METRICS = {"fail_share": ("try_divide(errs, calls)", True), "denied_share": ("try_divide(denied, calls)", True), "asks": ("cast(asks AS double)", True), "check_share": ("try_divide(checks, calls)", False)}


def experiment_means(spark: SparkSession, d: str) -> DataFrame:
    """Means of four measures before and after an edit of a repository's instructions."""
    j = _experiment_sessions(spark, d)
    long = j.select("repo", "after", F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.expr(v).alias("value")) for k, (v, _) in METRICS.items()])).alias("m")).where("m.value is not null")
    return long.groupBy("repo", "m.metric").agg(F.count_if(~F.col("after")).alias("n_before"), F.count_if("after").alias("n_after"), F.avg(F.when(~F.col("after"), F.col("m.value"))).alias("before"), F.avg(F.when(F.col("after"), F.col("m.value"))).alias("after"))


def experiments(spark: SparkSession, d: str) -> DataFrame:
    """The same with a seeded bootstrap interval, and whether a detectable change is for the better."""
    j = _experiment_sessions(spark, d)
    long = j.select(F.explode(F.array(*[F.struct(F.concat_ws("/", "repo", F.lit(k)).alias("grp"), F.col("after").alias("after"), F.expr(v).alias("value")) for k, (v, _) in METRICS.items()])).alias("m")).select("m.*")
    better = F.element_at(F.create_map(*[F.lit(x) for k, (_, less) in METRICS.items() for x in (k, less)]), F.substring_index("grp", "/", -1))
    return M.compare_groups(long).withColumn("improved", F.col("detectable") & ((F.col("diff") < 0) == better))


def edit_groups(spark: SparkSession, d: str) -> DataFrame:
    """Chains of session starts in one repository that lie less than three days apart."""
    s = _session_values(spark, d).select("repo", "session", "start")
    w = W.partitionBy("repo").orderBy("start", "session")
    new = F.coalesce(F.unix_timestamp("start") - F.unix_timestamp(F.lag("start").over(w)) >= 3 * 86400, F.lit(True))
    g = s.withColumn("chain", F.sum(F.when(new, 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return g.groupBy("repo", "chain").agg(F.count("*").alias("sessions"))


def changed_files(spark: SparkSession, d: str) -> DataFrame:
    """Anti-join: files of the raw feeds whose (lines, bytes) differ from those of the file before, or that are the first."""
    f = table(spark, d, "raw_records").where("raw is not null").groupBy("feed", "file_name", "written_on").agg(F.count("*").alias("n_lines"))
    w = W.partitionBy("feed").orderBy("written_on", "file_name")
    seen = f.withColumn("before", F.lag("n_lines").over(w))
    same = seen.where("before = n_lines").select("feed", "file_name")
    return f.join(same, ["feed", "file_name"], "left_anti").select("feed", "file_name", "n_lines")


def set_operations(spark: SparkSession, d: str) -> DataFrame:
    """Union, intersection and difference of the sessions of the log that have calls and those that have asks."""
    ev = E.chat_events(table(spark, d, "claude"))
    a = ev.where("kind = 'tool'").select("session").distinct()
    b = ev.where("kind = 'ask'").select("session").distinct()
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "n")
    return count(a.union(b).distinct(), "union").unionByName(count(a.intersect(b), "intersect")).unionByName(count(a.subtract(b), "except"))


def latest_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """The last snapshot of every stored session, by delivery."""
    s = table(spark, d, "oc_session").where("id is not null")
    return s.groupBy("id").agg(F.max_by("directory", "row_id").alias("directory"), F.max_by("machine", "row_id").alias("machine"), F.count("*").alias("snapshots"))


def redacted_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Secrets in the blocks of the log, by rule: how many, and in how many blocks; texts, thoughts, inputs and results are read."""
    b = table(spark, d, "claude").select("row_id", F.posexplode("message.content").alias("pos", "b"))
    each = b.select(F.concat_ws(":", "row_id", "pos").alias("key"), F.explode(F.array("b.text", "b.thinking", "b.input", "b.content")).alias("text"))
    return secrets_in(each.where("text is not null")).groupBy("rule").agg(F.count("*").alias("n"), F.count_distinct("key").alias("blocks"))


def input_entropy(spark: SparkSession, d: str) -> DataFrame:
    """Bits per character of the targets of calls, rounded to 1e-6, by distinct target."""
    t = E.chat_events(table(spark, d, "claude")).where("kind = 'tool' and target <> ''").select("target").distinct()
    return t.select("target", F.floor(entropy(F.col("target")) * 1e6 + 0.5).cast("bigint").alias("bits_e6"))


def hashed_features(spark: SparkSession, d: str) -> DataFrame:
    """FNV-1a buckets of the words of the asks."""
    ask = E.chat_events(table(spark, d, "claude")).where("kind = 'ask'").select(F.explode(F.split(F.regexp_replace(F.lower("text"), "[^a-z0-9']+", " "), " ")).alias("word")).where("word <> ''")
    n = ask.groupBy("word").agg(F.count("*").alias("n"))
    return n.select("word", "n", (M.fnv1a(F.concat(F.lit("w:"), F.col("word"))) % 8192).alias("bucket"))


# A small boosted model over session counters.
TREES = [
    {"feature": ["errs", "checks", "", "", ""], "threshold": [2, 0, 0, 0, 0], "left": [1, 3, -1, -1, -1], "right": [2, 4, -1, -1, -1], "value": [0, 0, 1.2, 0.1, -1.0]},
    {"feature": ["changes", "", ""], "threshold": [0, 0, 0], "left": [1, -1, -1], "right": [2, -1, -1], "value": [0, 0.4, -0.3]},
]


def tree_scores(spark: SparkSession, d: str) -> DataFrame:
    """A boosted-tree score of every session, compiled to CASE expressions."""
    ev = E.chat_events(table(spark, d, "claude"))
    c = session_counters(ev, S.with_moves(ev))
    return c.select("session", M.tree_score(TREES).alias("score"))


NAMES = (
    majority_vote, confusion_matrix, precision_recall, self_consistency, abstain_curve, span_overlap, hash_split, round_robin_sample, median_profile, adoption_effect, experiment_means, experiments, edit_groups, changed_files, set_operations,
    latest_snapshots, redacted_blocks, input_entropy, hashed_features, tree_scores,
)
QUERIES = {f.__name__: f for f in NAMES}

_V = """WITH v AS (SELECT item_key, labeler, lower(trim(arg_max(status, struct_pack(a := labeled_at, b := label_id)))) AS status FROM gold_labels WHERE status IS NOT NULL AND item_key IS NOT NULL AND labeler IS NOT NULL AND NOT coalesce(is_repeat, false) GROUP BY item_key, labeler),
 mj AS (SELECT item_key, status AS gold, agree, n FROM (SELECT *, row_number() OVER (PARTITION BY item_key ORDER BY agree DESC, status) AS k, CAST(sum(agree) OVER (PARTITION BY item_key) AS BIGINT) AS n FROM (SELECT item_key, status, count(*) AS agree FROM v GROUP BY ALL)) WHERE k = 1)"""
_CM = _V + ", cm AS (SELECT gold, status AS pred, count(*) AS n FROM v JOIN mj USING (item_key) GROUP BY ALL)"
from weftline.plans.sessions import _COUNTERS  # noqa: E402

_SV = _WITH + f", {_MV}, {_COUNTERS}, rp AS (SELECT sessionId AS session, min(cwd) AS repo, arg_max(permissionMode, row_id) FILTER (permissionMode IS NOT NULL) AS mode FROM claude WHERE sessionId IS NOT NULL AND cwd IS NOT NULL GROUP BY 1), sv AS (SELECT sc.*, repo, mode FROM sc JOIN rp USING (session))"
_AD = _SV + """, s AS (SELECT * REPLACE (coalesce(mode, 'unknown') AS mode) FROM sv), ad AS (SELECT repo, start AS adt FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY start, session) AS k, count(*) OVER (PARTITION BY repo) AS n FROM s WHERE start IS NOT NULL) WHERE k = n // 2 + 1)"""
SQL = {
    "majority_vote": _V + "SELECT item_key, gold, agree, n FROM mj",
    "confusion_matrix": _CM + "SELECT * FROM cm",
    "precision_recall": _CM + ", p AS (SELECT pred AS word, sum(n) AS predicted, sum(CASE WHEN gold = pred THEN n ELSE 0 END) AS r FROM cm GROUP BY 1), g AS (SELECT gold AS word, sum(n) AS gold_n FROM cm GROUP BY 1) SELECT word, CAST(coalesce(predicted, 0) AS BIGINT) AS predicted, CAST(coalesce(gold_n, 0) AS BIGINT) AS gold_n, CAST(coalesce(r, 0) AS BIGINT) AS right_n, coalesce(r, 0) / nullif(coalesce(predicted, 0), 0) AS precision, coalesce(r, 0) / nullif(coalesce(gold_n, 0), 0) AS recall FROM p FULL JOIN g USING (word)",
    "self_consistency": "WITH g AS (SELECT item_key, labeler, coalesce(is_repeat, false) AS rep, lower(trim(arg_max(status, struct_pack(a := labeled_at, b := label_id)))) AS status FROM gold_labels WHERE status IS NOT NULL AND item_key IS NOT NULL AND labeler IS NOT NULL GROUP BY ALL) SELECT a.labeler, count(*) AS n, count(*) FILTER (a.status = b.status) AS same FROM g a JOIN g b USING (item_key, labeler) WHERE NOT a.rep AND b.rep GROUP BY a.labeler",
    "abstain_curve": _V + ", c AS (SELECT agree / n AS conf, count(*) AS n, count(*) FILTER (status = gold) AS r FROM v JOIN mj USING (item_key) GROUP BY 1), k AS (SELECT conf, CAST(sum(n) OVER (ORDER BY conf DESC) AS BIGINT) AS answered, CAST(sum(r) OVER (ORDER BY conf DESC) AS BIGINT) AS right_n, sum(n) OVER () AS a FROM c) SELECT conf, answered, right_n, answered / a AS coverage, right_n / answered AS accuracy FROM k",
    "span_overlap": _WITH + f", {_MV}, h AS (SELECT *, ntile(2) OVER (PARTITION BY session ORDER BY i) AS half FROM mv WHERE target <> ''), s AS (SELECT session, coalesce(list(DISTINCT target) FILTER (half = 1), []) AS x, coalesce(list(DISTINCT target) FILTER (half = 2), []) AS y FROM h GROUP BY session) SELECT session, len(list_intersect(x, y)) AS common, len(list_distinct(list_concat(x, y))) AS all_n, len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) AS jaccard FROM s",
    "hash_split": "SELECT DISTINCT sessionId AS session, CASE WHEN CAST('0x' || left(sha256(sessionId || '|weft'), 8) AS BIGINT) / 4294967296.0 < 0.35 THEN 'test' ELSE 'dev' END AS split FROM claude WHERE sessionId IS NOT NULL",
    "round_robin_sample": "WITH it AS (SELECT item_key, lower(trim(arg_min(origin, label_id))) AS stratum FROM gold_labels WHERE origin IS NOT NULL AND item_key IS NOT NULL GROUP BY item_key) SELECT item_key, stratum, turn FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY sha256(item_key || '|11'), item_key) AS turn FROM it) ORDER BY turn, stratum LIMIT 40",
    "median_profile": _WITH + f", {_MV}, n AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY i) - 1 AS k FROM mv), f AS (SELECT session, min(k) AS before FROM n WHERE lane = 'change' GROUP BY session), rp AS (SELECT sessionId AS session, min(cwd) AS repo FROM claude WHERE sessionId IS NOT NULL AND cwd IS NOT NULL GROUP BY 1) SELECT repo, count(*) AS sessions, list_sort(list(before))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS median_before FROM f JOIN rp USING (session) GROUP BY repo",
    "adoption_effect": _AD + """, jj AS (SELECT s.*, adt, start >= adt AS after, errs > 0 AS hit FROM s JOIN ad USING (repo)), us AS (SELECT repo, coalesce(h.m, a.m) AS usual FROM (SELECT repo, max(struct_pack(n := n, m := mode)).m AS m FROM (SELECT repo, mode, count(*) AS n FROM jj WHERE NOT after AND hit GROUP BY ALL) GROUP BY repo) h FULL JOIN (SELECT repo, max(struct_pack(n := n, m := mode)).m AS m FROM (SELECT repo, mode, count(*) AS n FROM jj WHERE NOT after GROUP BY ALL) GROUP BY repo) a USING (repo)),
        la AS (SELECT repo, max(struct_pack(n := n, m := mode)).m AS mode_after FROM (SELECT repo, mode, count(*) AS n FROM jj WHERE after GROUP BY ALL) GROUP BY repo),
        g AS (SELECT repo, any_value(usual) AS mode, count(*) FILTER (mode = usual AND NOT after) AS n_before, count(*) FILTER (mode = usual AND NOT after AND hit) AS hit_before, count(*) FILTER (mode = usual AND after) AS n_after, count(*) FILTER (mode = usual AND after AND hit) AS hit_after, count(*) FILTER (after) AS all_after FROM jj JOIN us USING (repo) GROUP BY repo)
        SELECT repo, mode, mode_after, n_before, hit_before, n_after, hit_after, hit_before / nullif(n_before, 0) AS before_rate, hit_after / nullif(n_after, 0) AS after_rate, all_after > 0 AND mode_after <> mode AND n_after < all_after / 2 AS confounded, n_before >= 5 AND n_after >= 5 AS enough FROM g LEFT JOIN la USING (repo)""",
    "experiment_means": _AD + """, jj AS (SELECT * FROM (SELECT s.*, epoch(date_trunc('second', start)) - epoch(date_trunc('second', adt)) AS gap FROM s JOIN ad USING (repo)) WHERE abs(gap) < 21 * 86400), us AS (SELECT repo, max(struct_pack(n := n, m := mode)).m AS usual FROM (SELECT repo, mode, count(*) AS n FROM jj WHERE gap < 0 GROUP BY ALL) GROUP BY repo),
        k AS (SELECT jj.*, gap >= 0 AS late FROM jj JOIN us USING (repo) WHERE mode = usual), l AS (SELECT repo, late, 'fail_share' AS metric, errs / nullif(calls, 0) AS v FROM k UNION ALL SELECT repo, late, 'denied_share', denied / nullif(calls, 0) FROM k UNION ALL SELECT repo, late, 'asks', asks::DOUBLE FROM k UNION ALL SELECT repo, late, 'check_share', checks / nullif(calls, 0) FROM k)
        SELECT repo, metric, count(*) FILTER (NOT late) AS n_before, count(*) FILTER (late) AS n_after, avg(v) FILTER (NOT late) AS before, avg(v) FILTER (late) AS after FROM l WHERE v IS NOT NULL GROUP BY repo, metric""",
    "edit_groups": _SV + ", g AS (SELECT repo, session, start, lag(start) OVER (PARTITION BY repo ORDER BY start, session) AS p FROM sv), c AS (SELECT repo, CAST(sum(CASE WHEN p IS NULL OR epoch(date_trunc('second', start)) - epoch(date_trunc('second', p)) >= 3 * 86400 THEN 1 ELSE 0 END) OVER (PARTITION BY repo ORDER BY start, session) AS BIGINT) AS chain FROM g) SELECT repo, chain, count(*) AS sessions FROM c GROUP BY ALL",
    "changed_files": "WITH f AS (SELECT feed, file_name, written_on, count(*) AS n_lines FROM raw_records WHERE raw IS NOT NULL GROUP BY ALL) SELECT feed, file_name, n_lines FROM (SELECT *, lag(n_lines) OVER (PARTITION BY feed ORDER BY written_on, file_name) AS before FROM f) WHERE before IS NULL OR before <> n_lines",
    "set_operations": _WITH + ", a AS (SELECT DISTINCT session FROM ev WHERE kind = 'tool'), b AS (SELECT DISTINCT session FROM ev WHERE kind = 'ask') SELECT 'union' AS op, count(*) AS n FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'intersect', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'except', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)",
    "latest_snapshots": "SELECT id, arg_max(directory, row_id) FILTER (directory IS NOT NULL) AS directory, arg_max(machine, row_id) FILTER (machine IS NOT NULL) AS machine, count(*) AS snapshots FROM oc_session WHERE id IS NOT NULL GROUP BY id",
    "input_entropy": _WITH + ", t AS (SELECT DISTINCT target FROM ev WHERE kind = 'tool' AND target <> ''), c AS (SELECT target, unnest(string_split(target, '')) AS ch FROM t) SELECT target, CAST(floor(entropy(ch) * 1e6 + 0.5) AS BIGINT) AS bits_e6 FROM c GROUP BY target",
    "hashed_features": _WITH + ", w AS (SELECT unnest(string_split(regexp_replace(lower(text), '[^a-z0-9'']+', ' ', 'g'), ' ')) AS word FROM ev WHERE kind = 'ask'), n AS (SELECT word, count(*) AS n FROM w WHERE word <> '' GROUP BY word) SELECT word, n, list_reduce(list_prepend(2166136261::UBIGINT, list_transform(string_split('w:' || word, ''), lambda x: ascii(x)::UBIGINT)), lambda h, x: ((xor(h, x) * 16777619::UBIGINT) & 4294967295::UBIGINT))::BIGINT % 8192 AS bucket FROM n",
    "tree_scores": _WITH + f", {_MV}, {_COUNTERS} SELECT session, 1 / (1 + exp(-(0.1::DOUBLE * CASE WHEN errs <= 2 THEN CASE WHEN checks <= 0 THEN 0.1::DOUBLE ELSE -1.0::DOUBLE END ELSE 1.2::DOUBLE END + 0.1::DOUBLE * CASE WHEN changes <= 0 THEN 0.4::DOUBLE ELSE -0.3::DOUBLE END))) AS score FROM sc",
}
