"""The ledger of pieces of work: one row per piece with what was asked, what was done, how it ended and how sure that is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weftline.functions import phrases as P
from weftline.functions.text import first_sentence
from weftline.operators import pieces
from weftline.operators import steps as S
from weftline.operators import threads as T
from weftline.operators.stage import written

# Outcome of a piece in the vocabulary of documents.
SUCCESS = {
    "shipped_checked": "succeeded", "verified_change": "succeeded", "answered": "succeeded", "shipped_unchecked": "succeeded", "reported_change": "succeeded", "handed_back": "blocked",
    "blocked_reported": "blocked", "blocked_wall": "blocked", "abandoned": "failed", "open": "unknown", "unclear": "unknown",
}
# Vendors by the beginning of a model's name, and what a permission mode means.
PROVIDERS = (("anthropic", "claude"), ("openai", "^(gpt|o[0-9]|codex)"), ("google", "gemini"), ("xai", "grok"), ("deepseek", "deepseek"))
AUTHORITY = {"dontAsk": "policy/restricted", "bypassPermissions": "delegated/granted", "default": "explicit/granted", "acceptEdits": "delegated/restricted", "auto": "policy/restricted", "plan": "explicit/restricted"}

# Criteria that an ask may state, as phrases; all that match count, in this order.
CRITERIA: tuple[tuple[str, str], ...] = (
    ("pull_request", P.words("open ... pr; open ... pull request; create ... pr; create ... pull request; make ... pr; make ... pull request; raise ... pr; raise ... pull request; put up ... pr; put up ... pull request; submit ... pr; submit ... pull request; open pr; create pr")),
    ("merge", P.words("merge")),
    ("deploy", P.words("deploy; ship it; release; go live")),
    ("publish", P.words("publish")),
    ("commit", P.words("commit")),
    ("tests", P.words("test ... pass; tests ... pass; test ... green; tests ... green; tests pass; test passes; tests ... fix; tests ... fixed; tests ... work; specs ... pass; suite ... pass; suite ... green; fix ... test; fix ... tests; fix ... failing; fix ... flaky; fix ... red; make ... test; make ... tests; make ... failing; green")),
    ("typecheck", P.words("typecheck; type-check; tsc; type error; type errors")),
    ("build", P.words("build ... pass; builds ... pass; build ... green; build ... work; build ... fix; compile ... pass; compile ... work; compiles ... work; fix ... build")),
    ("answer", P.opening("why; what; how; where; when; which; who; can you explain; can you tell; can you check; can you find; explain; investigate; look into; figure out; summarize; summarise; review") + r"|\? *$"),
)
#: An ask to write a named file, and an ask for a change.
FILE_ASK = r"(?i)(?:^|[^a-z])(?:create|write|add|save)[^a-z.\n][^.\n]{0,30}?([A-Za-z0-9_@-][A-Za-z0-9_./@-]*\.(?:md|ts|tsx|js|mjs|py|json|yaml|yml|html|css|sql|sh|png|jpg|svg|pdf|csv))"
CHANGE_ASK = P.words("fix; implement; add; build; refactor; update; change; improve; make")
CONSTRAINT = r"(?i)(?:^|[^a-z])((?:do not|don't|dont|never|without|only|must not|avoid|no more than)[^a-z.;\n][^.;\n]{2,120})"
CHECKED = ("tests", "typecheck", "build", "answer", "file")


def base_name(c: Column) -> Column:
    """The last part of a path."""
    return F.regexp_extract(c, r"([^/]*)$", 1)


def criteria(asks: DataFrame) -> DataFrame:
    """(piece_id, id, criterion, file) of asks (piece_id, ask): what the ask says that has to be true in the end.

    Nine families of phrases in a fixed order, then a criterion per file to be written, then, where nothing else can be
    checked, that a change is made and checked. Asks without any have no row.
    """
    found = [F.when(F.col("ask").rlike(p), F.struct(F.lit(k).alias("criterion"), F.lit(None).cast("string").alias("file"))) for k, p in CRITERIA]
    files = F.transform(F.array_distinct(F.regexp_extract_all("ask", F.lit(FILE_ASK), F.lit(1))), lambda x: F.struct(F.lit("file").alias("criterion"), x.alias("file")))
    named = asks.where(F.col("ask").isNotNull()).withColumn("all", F.concat(F.array_compact(F.array(*found)), files))
    plain = ~F.exists("all", lambda x: x["criterion"].isin(*CHECKED)) & F.col("ask").rlike(CHANGE_ASK)
    last = F.when(plain, F.array(F.struct(F.lit("change_checked").alias("criterion"), F.lit(None).cast("string").alias("file")))).otherwise(F.array().cast("array<struct<criterion:string,file:string>>"))
    each = named.select("piece_id", F.posexplode(F.concat("all", last)).alias("pos", "c"))
    return each.select("piece_id", F.concat(F.lit("c"), (F.col("pos") + 1).cast("string")).alias("id"), "c.criterion", "c.file")


def constraints(asks: DataFrame) -> DataFrame:
    """(piece_id, nth, said): what asks forbid or limit, the first ten of each."""
    found = F.slice(F.regexp_extract_all("ask", F.lit(CONSTRAINT), F.lit(1)), 1, 10)
    return asks.where(F.col("ask").isNotNull()).select("piece_id", F.posexplode(found).alias("nth", "said")).select("piece_id", (F.col("nth") + 1).cast("bigint").alias("nth"), "said")


def piece_steps(events: DataFrame) -> DataFrame:
    """Events with facts; ``root`` is the piece that owns them, ``final_i`` the last position of the session."""
    ev = written(S.with_facts(events))
    p = pieces.with_piece(ev).withColumn("root", F.col("piece"))
    return p.join(ev.groupBy("session").agg(F.max("i").alias("final_i")), "session")


def checked_criteria(steps: DataFrame, stated: DataFrame) -> DataFrame:
    """(piece_id, id, criterion, status, confidence): each stated criterion met, unmet or unknown, by the last step that decides it.

    Pending calls decide nothing. A check counts after the last edit of code; an answer is a last message of more than
    160 characters; a change is checked by any check after the last edit, and unmet without an edit.
    """
    tool = (F.col("kind") == "tool") & ~F.coalesce("pending", F.lit(False))
    good = ~F.col("result").isin("fail", "denied")
    w = W.partitionBy("piece_id")
    ev = steps.withColumn("code_at", F.coalesce(F.max(F.when(tool & F.col("code"), F.col("i"))).over(w), F.lit(-1))).withColumn("edit_at", F.max(F.when(tool & (F.col("action") == "edit"), F.col("i"))).over(w))
    last = lambda c, v: F.max_by(v, F.when(c, F.col("i")))
    check = lambda a: tool & (F.col("action") == a) & (F.col("i") > F.col("code_at"))
    by = ev.groupBy("piece_id").agg(
        last(tool & (F.contains("target", F.lit("gh pr create")) | F.col("pr").isNotNull()), good).alias("pull_request"), last(tool & F.col("target").rlike("gh pr merge|git merge"), good).alias("merge"),
        last(tool & (F.col("action") == "deploy"), good).alias("deploy"), last(tool & ((F.col("action") == "deploy") | F.contains("target", F.lit("publish"))), good).alias("publish"), last(tool & F.col("action").isin("commit", "ship"), good).alias("commit"),
        *[x for k, a in (("tests", "test"), ("typecheck", "typecheck"), ("build", "build")) for x in (last(check(a), good).alias(k), last(check(a), F.col("result") == "pass").alias(f"{k}_passed"))],
        last(F.col("kind") == "say", F.length("text") > 160).alias("answer"), last(tool & F.col("action").isin(*S.CHECKS) & (F.col("i") > F.col("edit_at")), good).alias("change_checked"), F.max("edit_at").alias("edit_at"),
    )
    edits = ev.where(tool & (F.col("action") == "edit")).groupBy("piece_id", base_name(F.col("target")).alias("base")).agg(F.max_by(F.col("result") != "fail", "i").alias("wrote"))
    j = stated.withColumn("base", base_name(F.col("file"))).join(by, "piece_id", "left").join(edits, ["piece_id", "base"], "left")
    plain = ("pull_request", "merge", "deploy", "publish", "commit", "tests", "typecheck", "build", "answer", "change_checked")
    met = F.when(F.col("criterion") == "file", F.col("wrote")).otherwise(F.element_at(F.create_map(*[x for k in plain for x in (F.lit(k), F.col(k))]), F.col("criterion")))
    no_edit = (F.col("criterion") == "change_checked") & F.col("edit_at").isNull()
    passed = F.when(F.col("criterion") == "tests", F.col("tests_passed")).when(F.col("criterion") == "typecheck", F.col("typecheck_passed")).when(F.col("criterion") == "build", F.col("build_passed"))
    sure = F.when(F.col("criterion").isin("pull_request", "file"), 0.85).when(F.col("criterion").isin("merge", "deploy", "publish", "commit"), 0.8).when(passed, 0.9).otherwise(0.6)
    return j.withColumn("met", met).select(
        "piece_id", "id", "criterion", F.when(no_edit, "unmet").when(F.col("met").isNull(), "unknown").when(F.col("met"), "met").otherwise("unmet").alias("status"),
        F.when(no_edit, 0.5).when(F.col("met").isNull(), 0.3).otherwise(sure).alias("confidence"),
    )


def verification(steps: DataFrame) -> DataFrame:
    """(piece_id, verification, n_checks): the checks run after the last edit, all and any: unverified, passed, partial, inconclusive or failed."""
    tool = (F.col("kind") == "tool") & ~F.coalesce("pending", F.lit(False))
    at = F.coalesce(F.max(F.when(tool & (F.col("action") == "edit"), F.col("i"))).over(W.partitionBy("piece_id")), F.lit(-1))
    check = tool & F.col("action").isin(*S.CHECKS) & (F.col("i") > F.col("edit_at")) & (F.col("result") != "denied")
    n = steps.withColumn("edit_at", at).groupBy("piece_id").agg(F.count_if(check).alias("n"), F.count_if(check & (F.col("result") == "pass")).alias("good"), F.count_if(check & (F.col("result") == "ok")).alias("open"))
    v = F.when(F.col("n") == 0, "unverified").when(F.col("good") == F.col("n"), "passed").when(F.col("good") > 0, "partial").when(F.col("open") == F.col("n"), "inconclusive").otherwise("failed")
    return n.select("piece_id", v.alias("verification"), F.col("n").alias("n_checks"))


def repo_of(cwd: Column) -> Column:
    """The repository of a working directory: worktrees fold into their main checkout."""
    folded = F.regexp_replace(F.regexp_replace(cwd, r"/\.(claude|codex|cursor)/worktrees/[^/]+.*$", ""), r"/worktrees/[^/]+$", "")
    return F.nullif(base_name(folded), F.lit(""))


def provider_of(model: Column) -> Column:
    """The vendor of a model by its name."""
    case = None
    for name, p in PROVIDERS:
        hit = F.coalesce(F.lower(model).rlike(p), F.lit(False))
        case = F.when(hit, name) if case is None else case.when(hit, name)
    return case.otherwise("unknown")


def sessions(records: DataFrame) -> DataFrame:
    """(session, repo, cwd, mode, model, provider, authority): the facts of a session, each the most frequent value; ties go to the larger."""
    r = records.where("sessionId is not null").select(F.col("sessionId").alias("session"), "cwd", F.col("permissionMode").alias("mode"), F.col("message.model").alias("model"))
    top = None
    for c in ("cwd", "mode", "model"):
        n = r.where(F.col(c).isNotNull()).groupBy("session", c).agg(F.count("*").alias("n")).groupBy("session").agg(F.max_by(c, F.struct("n", c)).alias(c))
        top = n if top is None else top.join(n, "session", "full")
    all_ = r.select("session").distinct().join(top, "session", "left")
    authority = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in AUTHORITY.items() for x in kv]), F.col("mode")), F.lit("unknown/unknown"))
    return all_.select("session", repo_of(F.col("cwd")).alias("repo"), "cwd", "mode", "model", provider_of(F.col("model")).alias("provider"), authority.alias("authority"))


def ledger(steps: DataFrame, facts: DataFrame, checked: DataFrame, types: DataFrame) -> DataFrame:
    """One row per piece: what a search filters by and a list shows."""
    own = steps.groupBy("session", "piece", "piece_id").agg(
        F.min("ts").alias("start"), F.max("ts").alias("last"), F.min_by("text", F.when(pieces.opens_piece(), F.col("i"))).alias("ask"), F.count_if(F.col("kind") == "tool").alias("n_calls"), F.count_if("err").alias("n_errs"),
        F.array_sort(F.collect_set(F.col("pr").cast("string"))).alias("prs"), F.array_sort(F.collect_set(F.when((F.col("action") == "edit") & ~F.col("err"), F.col("target")))).alias("files"),
    )
    out = T.goal_outcomes(steps).withColumnRenamed("root", "piece").drop("n_steps", "checked_after_change")
    unmet = checked.where("status = 'unmet'").groupBy("piece_id").agg(F.array_sort(F.collect_set("criterion")).alias("unmet"))
    words = F.create_map(*[F.lit(x) for kv in SUCCESS.items() for x in kv])
    j = own.join(out, ["session", "piece"]).join(verification(steps), "piece_id").join(facts, "session", "left").join(unmet, "piece_id", "left").join(types, "piece_id", "left")
    none = F.array().cast("array<string>")
    plain = F.element_at(words, F.col("outcome"))
    return j.select(
        "piece_id", "session", "piece", "start", "last", "ask", first_sentence(F.col("ask")).alias("title"), "n_calls", "n_errs", F.lit("claude").alias("client"), "repo", "mode", "provider", "outcome", "status",
        F.when((plain == "succeeded") & (F.size(F.coalesce("unmet", none)) > 0), "partially_succeeded").otherwise(plain).alias("success"), "confidence", "verification", F.coalesce("work_type", F.lit("other")).alias("work_type"), "prs", "files", F.coalesce("unmet", none).alias("unmet"),
    )
