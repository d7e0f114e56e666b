"""Further queries: guards, validation, coverage, sparklines, matching by time and by rank, evidence texts, trained models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weftline.functions.text import redact
from weftline.operators import events as E
from weftline.operators import measures as M
from weftline.operators import pieces
from weftline.operators import steps as S
from weftline.operators.stage import running, written
from weftline.plans.evaluation import votes
from weftline.plans.sessions import _HITS, _MV, _WITH
from weftline.sources.tables import table


def _events(spark: SparkSession, d: str) -> DataFrame:
    return E.chat_events(table(spark, d, "claude"))


def guarded_calls(spark: SparkSession, d: str, least: int = 3) -> DataFrame:
    """Calls of a kind that already met a denial in ``least`` sessions or more: what a guard would stop before it runs."""
    ev = written(_events(spark, d))
    hit = S.wall_hits(ev).where("named and sig like 'denied%'")
    walls = hit.groupBy("sig", F.lower("tool").alias("kind")).agg(F.count_distinct("session").alias("met")).where(F.col("met") >= least)
    calls = ev.where("kind = 'tool'").select("session", "i", F.lower("tool").alias("t"), "target")
    chained = F.col("target").rlike(r"&&|\|\||;")
    fits = (F.col("sig") != "denied-chain") | chained
    return calls.join(walls, (F.col("t") == F.col("kind")) & fits).groupBy("sig", "kind").agg(F.count("*").alias("calls"), F.max("met").alias("met"))


def label_problems(spark: SparkSession, d: str) -> DataFrame:
    """Constraint checks of the label form, counted: missing keys, words outside the codebook, repeats without a first label."""
    g = table(spark, d, "gold_labels")
    words = {"origin": ("asked", "plan", "found", "recovery", "wall", "scheduled"), "status": ("done", "dropped", "parked", "open", "unclear"), "boundary": ("right", "too_big", "too_small", "not_a_thread")}
    bad = [F.when(F.col(c).isNotNull() & ~F.col(c).isin(*w), F.lit(f"{c}_outside")) for c, w in words.items()]
    bad += [F.when(F.col(c).isNull(), F.lit(f"{c}_missing")) for c in ("item_key", "labeler", "labeled_at", *words)]
    bad += [F.when(~F.coalesce(F.col("item_key").rlike("^[0-9a-f-]{36}:[0-9]+$"), F.lit(False)), F.lit("key_form"))]
    return g.select(F.explode(F.array_compact(F.array(*bad))).alias("problem")).groupBy("problem").agg(F.count("*").alias("n"))


def record_problems(spark: SparkSession, d: str) -> DataFrame:
    """Constraint checks of the log: doubled records, parents that are nowhere, results without a call, calls without a result."""
    c = table(spark, d, "claude")
    rec = c.select("uuid", "parentUuid")
    doubled = rec.groupBy("uuid").agg(F.count("*").alias("n")).where("n > 1").agg(F.sum(F.col("n") - 1).alias("n"))
    lost = rec.where("parentUuid is not null").join(rec.select(F.col("uuid").alias("parentUuid")), "parentUuid", "left_anti").agg(F.count("*").alias("n"))
    b = c.select(F.explode("message.content").alias("b"))
    calls = b.where(F.col("b.type") == "tool_use").select(F.col("b.id").alias("id")).distinct()
    res = b.where(F.col("b.type") == "tool_result").select(F.col("b.tool_use_id").alias("id")).distinct()
    one = lambda df, name: df.select(F.lit(name).alias("problem"), F.coalesce("n", F.lit(0)).alias("n"))
    return one(doubled, "doubled").unionByName(one(lost, "lost_parent")).unionByName(one(calls.join(res, "id", "left_anti").agg(F.count("*").alias("n")), "no_result")).unionByName(one(res.join(calls, "id", "left_anti").agg(F.count("*").alias("n")), "no_call"))


def text_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Characters of the log by kind of block."""
    b = table(spark, d, "claude").select(F.explode("message.content").alias("b"))
    return b.groupBy(F.col("b.type").alias("type")).agg(F.count("*").alias("blocks"), F.sum(F.coalesce(F.length("b.text"), F.lit(0)) + F.coalesce(F.length("b.thinking"), F.lit(0)) + F.coalesce(F.length("b.content"), F.lit(0)) + F.coalesce(F.length("b.input"), F.lit(0))).alias("chars"))


def week_sparkline(spark: SparkSession, d: str) -> DataFrame:
    """The last sixteen weeks of failed calls, as eighths of the busiest; the limit is the feature."""
    w = S.with_moves(_events(spark, d)).groupBy(F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd").alias("week")).agg(F.count_if("err").alias("errs"))
    top = w.withColumn("most", F.max("errs").over(W.partitionBy(F.lit(0)))).orderBy(F.desc("week")).limit(16)
    return top.select("week", "errs", F.coalesce(F.floor(F.try_divide(F.col("errs") * 8, F.col("most"))), F.lit(0)).cast("bigint").alias("bar"))


def reasoning_matches(spark: SparkSession, d: str, ms: int = 2000) -> DataFrame:
    """Fuzzy match by time: parts of text and of reasoning of one message that lie less than ``ms`` apart, joined over buckets of time."""
    p = table(spark, d, "oc_part").where("time_created is not null").select("message_id", "id", "time_created", F.get_json_object("data", "$.type").alias("type"))
    a = p.where("type = 'text'").select("message_id", F.col("id").alias("text_id"), F.col("time_created").alias("t"), F.explode(F.array(*[F.floor(F.col("time_created") / ms) + k for k in (-1, 0, 1)])).alias("bucket"))
    b = p.where("type = 'reasoning'").select("message_id", F.col("id").alias("think_id"), F.col("time_created").alias("u"), F.floor(F.col("time_created") / ms).alias("bucket"))
    return a.join(b, ["message_id", "bucket"]).where(F.abs(F.col("t") - F.col("u")) < ms).select("message_id", "text_id", "think_id")


def greedy_matching(spark: SparkSession, d: str) -> DataFrame:
    """One-to-one matches in order: the n-th failure of a tool in a session with its n-th success; what is left over has no partner."""
    ev = _events(spark, d).where("kind = 'tool'").withColumn("tool", F.lower("tool"))
    n = ev.withColumn("n", F.row_number().over(W.partitionBy("session", "tool", "err").orderBy("i"))).select("session", "tool", "err", "n", "i")
    good = n.where("not err").select("session", "tool", "n", F.col("i").alias("ok_i"))
    return n.where("err").join(good, ["session", "tool", "n"]).select("session", "tool", F.col("i").alias("failed_i"), "ok_i")


def evidence_texts(spark: SparkSession, d: str, cap: int = 14_000) -> DataFrame:
    """A numbered log of every piece, with three events on either side (``~``), reasoning before the event it led to, errors,
    output and a line on how it ends; the middle left out where it is longer than ``cap``: 55 % head and 40 % tail stay.

    The limits of a line are the reference's; secrets are redacted in the whole texts, before any is cut.
    """
    rec = E.distinct_records(table(spark, d, "claude"))
    # Calls, results and reasoning are all read from it, so it is written once.
    rec = written(rec.select("row_id", "sessionId", "ingested_at", F.struct("message.role", "message.content").alias("message")))
    return evidence(E.events_of(rec, "pos", "full", "r_text"), E.reasoning_of(rec), cap)


def evidence(events: DataFrame, reasoning: DataFrame, cap: int) -> DataFrame:
    """(piece_id, evidence) of ``events`` with pos, full and r_text, and of ``reasoning`` (session, row_id, pos, text)."""
    flat = lambda c, n: F.substring(F.regexp_replace(c, r"\s+", " "), 1, n)
    clean = redact(F.coalesce(F.when(F.col("kind") == "tool", F.col("r_text")).otherwise(F.col("full")), F.lit("")))
    p = pieces.with_piece(events).withColumn("said", clean).withColumn("target", redact(F.coalesce("target", F.lit(""))))
    failed = F.concat(F.lit(" => "), F.when(F.col("denied"), "DENIED").otherwise("FAILED"), F.lit(": "), flat("said", 220))
    call = F.concat(F.lit("TOOL "), F.coalesce("tool", F.lit("")), F.lit(": "), F.col("target"), F.when(F.col("err"), failed).when(F.col("said") != "", F.concat(F.lit(" => "), flat("said", 160))).otherwise(""))
    body = F.when(F.col("kind") == "tool", call).otherwise(F.concat(F.when(F.col("kind") == "ask", "PERSON: ").otherwise("AGENT: "), flat("said", 1500)))
    ev = written(p.select("session", "i", "row_id", "pos", "piece_id", body.alias("body")))
    ends = ev.groupBy("session", "piece_id").agg(F.min("i").alias("first"), F.max("i").alias("last"))
    ends = written(ends.withColumn("final", F.max("last").over(W.partitionBy("session"))))
    near = F.concat(F.sequence(F.col("first") - 3, F.col("first") - 1), F.sequence(F.col("last") + 1, F.col("last") + 3))
    around = ends.select("session", "piece_id", F.explode(near).alias("i")).join(ev.select("session", "i", "body"), ["session", "i"])
    line = lambda mark: F.substring(F.concat(F.lit("["), F.col("i").cast("string"), F.lit("]" + mark), F.col("body")), 1, 1500)
    # A thought goes before the event that follows it; of two at one event the order of delivery stands. Read from the end,
    # that event is the last one so far: a frame open to the end would be gone through anew for every row of a session.
    thought = reasoning.select("session", "row_id", "pos", F.lit(None).cast("bigint").alias("i"), F.lit(None).cast("string").alias("piece_id"), "text")
    mixed = ev.select("session", "row_id", "pos", "i", "piece_id", F.lit(None).cast("string").alias("text")).unionByName(thought)
    back = mixed.withColumn("back", -F.col("row_id")).withColumn("back_pos", -F.col("pos"))
    led = running(back, "session", "back", ["back", "back_pos"], lasts={"next": F.when(F.col("i").isNotNull(), F.struct("i", "piece_id"))}, before=True).where("text is not null and next is not null")
    led = led.select("next.piece_id", F.col("next.i").alias("i"), F.lit(0).alias("kind"), "row_id", "pos", F.concat(F.lit("[r] REASONING: "), flat(redact(F.col("text")), 900)).alias("l"))
    at = lambda df, mark: df.select("piece_id", "i", F.lit(1).alias("kind"), F.lit(0).cast("bigint").alias("row_id"), F.lit(0).alias("pos"), line(mark).alias("l"))
    rows = at(ev, " ").unionByName(at(around, "~")).unionByName(led)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "kind", "row_id", "pos", "l"))), lambda x: x["l"]), "\n")
    left = F.col("final") - F.col("last")
    end = F.when(left <= 0, F.format_string("[end] The session ends at this piece's last event [%d].", "last")).otherwise(
        F.format_string("[end] This piece's last event is [%d]. The session continued for %d more events (the first %d are shown with ~).", "last", left, F.least(F.lit(3).cast("bigint"), left)))
    t = rows.groupBy("piece_id").agg(text.alias("t"), (F.count("*") + 1).alias("n")).join(ends, "piece_id").withColumn("t", F.concat_ws("\n", "t", end))
    head, tail = int(cap * 0.55), int(cap * 0.4)
    short = F.concat(F.substring("t", 1, head), F.format_string("\n… [%d events total; middle omitted] …\n", "n"), F.expr(f"right(t, {tail})"))
    return t.select("piece_id", F.when(F.length("t") > cap, short).otherwise(F.col("t")).alias("evidence"))


def _before(links: DataFrame) -> DataFrame:
    """(piece_id, before): the surest of the pieces that each piece takes up, at a tie the larger name."""
    return links.groupBy(F.col("b").alias("piece_id")).agg(F.max(F.struct("confidence", "a")).alias("m")).select("piece_id", F.col("m.a").alias("before"))


def label_inheritance(spark: SparkSession, d: str) -> DataFrame:
    """Work types of pieces, short follow-ups taking the type of the piece they take up, along chains of any length."""
    from weftline.operators.worktypes import LOW
    from weftline.plans.ledger import work_types
    from weftline.plans.work import continuations

    own = written(work_types(spark, d))
    up = written(_before(continuations(spark, d)).join(own.where((F.col("work_type").isin("other", "follow_up")) | (F.col("confidence") < LOW)).select("piece_id"), "piece_id", "left_semi").select("piece_id", "before"))
    state = written(own.join(up, "piece_id", "left").select("piece_id", "work_type", F.coalesce("before", "piece_id").alias("at"), F.lit(0).cast("bigint").alias("steps")))
    while True:  # pointer doubling; chains end at a piece with a type or without one before it
        nxt = state.select(F.col("piece_id").alias("at"), F.col("at").alias("at2"), F.col("steps").alias("more"))
        new = written(state.join(nxt, "at").select("piece_id", "work_type", F.col("at2").alias("at"), (F.col("steps") + F.col("more") + F.when(F.col("at") != F.col("at2"), 1).otherwise(0)).alias("steps"), (F.col("at") != F.col("at2")).alias("moved")))
        state = new.select("piece_id", "work_type", "at", "steps")
        if new.where("moved").isEmpty():
            break
    top = own.select(F.col("piece_id").alias("at"), F.col("work_type").alias("inherited"))
    return state.join(top, "at").select("piece_id", F.col("inherited").alias("work_type"), (F.col("at") != F.col("piece_id")).alias("inherited"))


def act_model(spark: SparkSession, d: str) -> DataFrame:
    """A softmax model of what messages do, on hashed words, trained on the sessions of one hash split and scored on the other."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF

    m = S.with_acts(_events(spark, d)).where("kind = 'say'").withColumn("split", M.hash_split(F.col("session"), "weft", 0.35))
    acts = [a for a, _ in S.ACTS] + ["other"]
    words = F.filter(F.split(F.regexp_replace(F.lower("text"), "[^a-z0-9']+", " "), " "), lambda w: w != "")
    x = HashingTF(numFeatures=4096, inputCol="words", outputCol="features").transform(m.withColumn("words", words).withColumn("label", (F.array_position(F.array(*map(F.lit, acts)), F.col("act")) - 1).cast("double")))
    train = written(x.where("split = 'dev'").select("features", "label"))
    model = LogisticRegression(family="multinomial", maxIter=20, regParam=0.01).fit(train)
    scored = model.transform(x.where("split = 'test'"))
    return scored.groupBy("act").agg(F.count("*").alias("n"), F.count_if(F.col("prediction") == F.col("label")).alias("right_n"))


def label_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of labelers: items both labelled, and how often they agree; each item's labelers are few and known to the form."""
    v = votes(spark, d)
    a, b = v.select("item_key", F.col("labeler").alias("x"), F.col("status").alias("p")), v.select("item_key", F.col("labeler").alias("y"), F.col("status").alias("q"))
    return a.join(b, "item_key").where("x < y").groupBy("x", "y").agg(F.count("*").alias("n"), F.count_if(F.col("p") == F.col("q")).alias("same"))


NAMES = (guarded_calls, label_problems, record_problems, text_coverage, week_sparkline, reasoning_matches, greedy_matching, evidence_texts, label_inheritance, act_model, label_agreement)
QUERIES = {f.__name__: f for f in NAMES}
_V = """WITH v AS (SELECT item_key, labeler, lower(trim(arg_max(status, struct_pack(a := labeled_at, b := label_id)))) AS status FROM gold_labels WHERE status IS NOT NULL AND item_key IS NOT NULL AND labeler IS NOT NULL AND NOT coalesce(is_repeat, false) GROUP BY item_key, labeler)"""
SQL = {
    "guarded_calls": _WITH + f", {_HITS}, w AS (SELECT sig, lower(tool) AS kind, count(DISTINCT session) AS met FROM hits WHERE wall IS NOT NULL AND sig LIKE 'denied%' GROUP BY ALL HAVING count(DISTINCT session) >= 3) SELECT sig, w.kind, count(*) AS calls, max(met) AS met FROM ev JOIN w ON lower(ev.tool) = w.kind AND (sig <> 'denied-chain' OR regexp_matches(target, '&&|\\|\\||;')) WHERE ev.kind = 'tool' GROUP BY sig, w.kind",
    "record_problems": "WITH b AS (SELECT unnest(message.content) AS b FROM claude), ca AS (SELECT DISTINCT b.id AS id FROM b WHERE b.type = 'tool_use'), re AS (SELECT DISTINCT b.tool_use_id AS id FROM b WHERE b.type = 'tool_result') SELECT 'doubled' AS problem, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS n FROM (SELECT count(*) AS n FROM claude GROUP BY uuid) UNION ALL SELECT 'lost_parent', count(*) FROM claude c WHERE parentUuid IS NOT NULL AND NOT EXISTS (SELECT 1 FROM claude p WHERE p.uuid = c.parentUuid) UNION ALL SELECT 'no_result', count(*) FROM ca WHERE NOT EXISTS (SELECT 1 FROM re WHERE re.id = ca.id) UNION ALL SELECT 'no_call', count(*) FROM re WHERE NOT EXISTS (SELECT 1 FROM ca WHERE re.id = ca.id)",
    "text_coverage": "SELECT b.type AS type, count(*) AS blocks, CAST(sum(coalesce(length(b.text), 0) + coalesce(length(b.thinking), 0) + coalesce(length(b.content), 0) + coalesce(length(b.input), 0)) AS BIGINT) AS chars FROM (SELECT unnest(message.content) AS b FROM claude) GROUP BY 1",
    "week_sparkline": _WITH + f", {_MV}, w AS (SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, count(*) FILTER (err) AS errs FROM mv GROUP BY 1) SELECT week, errs, CAST(coalesce(floor(errs * 8 / nullif(m, 0)), 0) AS BIGINT) AS bar FROM (SELECT *, max(errs) OVER () AS m FROM w) ORDER BY week DESC LIMIT 16",
    "reasoning_matches": "WITH p AS (SELECT message_id, id, time_created, CASE WHEN json_valid(data) THEN json_extract_string(data, '$.type') END AS type FROM oc_part WHERE time_created IS NOT NULL) SELECT a.message_id, a.id AS text_id, b.id AS think_id FROM p a JOIN p b USING (message_id) WHERE a.type = 'text' AND b.type = 'reasoning' AND abs(a.time_created - b.time_created) < 2000",
    "greedy_matching": _WITH + ", n AS (SELECT session, lower(tool) AS tool, err, i, row_number() OVER (PARTITION BY session, lower(tool), err ORDER BY i) AS n FROM ev WHERE kind = 'tool') SELECT a.session, a.tool, a.i AS failed_i, b.i AS ok_i FROM n a JOIN n b USING (session, tool, n) WHERE a.err AND NOT b.err",
    "label_agreement": _V + "SELECT a.labeler AS x, b.labeler AS y, count(*) AS n, count(*) FILTER (a.status = b.status) AS same FROM v a JOIN v b USING (item_key) WHERE a.labeler < b.labeler GROUP BY ALL",
    "label_problems": """WITH g AS (SELECT list_filter([CASE WHEN origin NOT IN ('asked','plan','found','recovery','wall','scheduled') THEN 'origin_outside' END, CASE WHEN status NOT IN ('done','dropped','parked','open','unclear') THEN 'status_outside' END, CASE WHEN boundary NOT IN ('right','too_big','too_small','not_a_thread') THEN 'boundary_outside' END,
        CASE WHEN item_key IS NULL THEN 'item_key_missing' END, CASE WHEN labeler IS NULL THEN 'labeler_missing' END, CASE WHEN labeled_at IS NULL THEN 'labeled_at_missing' END, CASE WHEN origin IS NULL THEN 'origin_missing' END, CASE WHEN status IS NULL THEN 'status_missing' END, CASE WHEN boundary IS NULL THEN 'boundary_missing' END,
        CASE WHEN NOT coalesce(regexp_matches(item_key, '^[0-9a-f-]{36}:[0-9]+$'), false) THEN 'key_form' END], lambda x: x IS NOT NULL) AS p FROM gold_labels) SELECT problem, count(*) AS n FROM (SELECT unnest(p) AS problem FROM g) GROUP BY 1""",
}
