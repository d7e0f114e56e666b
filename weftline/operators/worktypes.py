"""The kind of work of a piece: scores of thirteen kinds by what was asked and by what was done."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import phrases as P

# Kinds of work with the words of an ask that speak for each.
KINDS: dict[str, str] = {
    "fix": "fix; bug; broken; error; fail; fails; failing; crash; regression; not working; doesn't work; doesnt work; isn't; isnt; wrong; issue; exception; traceback; undefined; null; 500; 404",
    "feature": "implement; add; build; create; new; support; enable; introduce; scaffold; make a; make an; make the",
    "improve": "improve; better; polish; refine; cleanup; clean up; consistent; spacing; layout; faster; optimize; optimise; simplify; upgrade; enhance; tighten",
    "refactor": "refactor; restructure; extract; rename; move; split; consolidate; dedupe; reorganize; reorganise; migrate to",
    "investigate": "why; what; how; where; when; which; investigate; diagnose; root cause; figure out; look into; explain; understand; trace",
    "review": "audit; review; critique; assess; evaluate; verify; check that; check if; check whether; grade; score",
    "ship": "merge; deploy; publish; release; ship; push; commit; open pr; open a pr; tag; rollout; go live",
    "design": "design; mockup; figma; visual; aesthetic; color; colour; font; typography; animation; motion; video; reel; image; logo; icon; css; style",
    "write": "write; draft; doc; docs; readme; post; tweet; thread; linkedin; blog; copy; deck; slides; email; spec; memo; brief; outline; summary",
    "data": "sql; query; queries; migration; schema; table; dataset; csv; xlsx; analyze; analyse; metric; metrics; dashboard; supabase; postgres",
    "ops": "config; env; setup; set up; install; ci; pipeline; workflow; docker; vps; dns; domain; cron; launchd; key; secret; permission; credential; auth; authentication",
    "research": "research; compare; competitor; market; state of the art; sota; paper; papers; survey; benchmark; options; alternatives",
    "routine": "[scheduled]",
}
# The verb that an ask begins with, and what it means.
LEADS: dict[str, str] = {
    "fix": "fix debug resolve repair patch troubleshoot", "feature": "implement add build create integrate introduce support", "improve": "improve revamp rethink rework put change adjust tweak remove delete replace polish tidy clean", "refactor": "refactor rename move extract split restructure",
    "investigate": "why what how investigate explain find trace understand", "review": "review audit check verify assess evaluate", "ship": "merge deploy publish release ship push commit open", "design": "redesign design restyle", "write": "write draft document summarize", "data": "query migrate analyze", "ops": "install configure connect set", "research": "research compare plan brainstorm",
}
OPENERS = "yes; yeah; ok; okay; so; now; please; pls; also; and; then; great; cool; perfect; nice; alright; all right; can you; can we; could you; could we; would you; will you; should we; shall we; let's; lets; i want you to; i need you to; we need to; we should; we have to; go ahead and; help me; try to"
REPORTS = "still not; still no; still broken; still showing; is not working; isn't working; isn't showing; isn't loading; isn't saving; doesn't show; doesn't load; doesn't save; not working; not showing; not loading; not saving; not updating; should be; should show; should not; instead of; keeps failing; keep failing; keeps crashing; keeps logging; is showing; shows wrong; shows the wrong; getting error; getting an error; returns only; returns nothing; returns empty; fails again"
PASTED = r"Error|Exception|Traceback|ERR!|at [^\n]+:[0-9]+:[0-9]+|(^|[^a-z])line [0-9]+|Failed to|Uncaught"
FOLLOW_UPS = "yes; yep; ok; okay; sure; do it; go; go ahead; continue; proceed; next; keep going; apply; all of them; all of it; do all; do both; do the rest; go on; ok ship it"
LOW = 0.55

_alternatives = lambda s: "|".join(re.escape(x.strip()).replace(r"\ ", " ").replace("'", "['’]?") for x in s.split(";"))
PATTERNS = {k: rf"(?i)\b({_alternatives(v)})\b" if k != "routine" else r"(?i)^ *\[scheduled\]" for k, v in KINDS.items()}
OPENER = rf"(?i)^([ \t\n]*({_alternatives(OPENERS)})[,.!]?[ \t\n]+)+"
REPORT, FOLLOW_UP = P.words(REPORTS), P.opening(FOLLOW_UPS)
LEAD = {w: k for k, ws in LEADS.items() for w in ws.split()}


def classify(df: DataFrame) -> DataFrame:
    """(piece_id, work_type, confidence, runner_up) of rows (piece_id, ask, n, edits, reads, ships, web: shares of the calls, prose, visual: what was put out).

    An ask is read on its first 400 characters, as the measure has it. Asks that only say to go on are ``follow_up``.
    """
    head = F.substring("ask", 1, 400)
    verb = F.regexp_extract(F.lower(F.regexp_replace("ask", OPENER, "")), r"^[^a-z]*([a-z]+)", 1)
    lead = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in LEAD.items() for x in kv]), verb), F.lit(""))
    col = F.col
    still, many = (col("edits") == 0) & ((col("reads") > 0.3) | (col("n") <= 2)), col("edits") > 0.25
    out = df.withColumn("head", head).withColumn("lead", lead)

    def score(k: str) -> Column:
        hits = F.regexp_count("head", F.lit(PATTERNS[k]))
        s = F.when(hits > 0, 0.6 + 0.4 * F.least(F.lit(2), hits - 1)).otherwise(0.0) + F.when(col("lead") == k, 2.2).otherwise(0.0)
        plus = {
            "fix": [(col("ask").rlike(PASTED), 2.2), (col("head").rlike(REPORT), 1.4)], "routine": [(col("ask").rlike(PATTERNS["routine"]), 6.0)],
            "investigate": [(still, 1.2)], "review": [(still, 0.6)],
        }
        for cond, x in plus.get(k, []):
            s = s + F.when(cond, x).otherwise(0.0)
        times = {"fix": [(still, 0.7)], "feature": [(still, 0.6)], "investigate": [(many, 0.6)]}
        for cond, x in times.get(k, []):
            s = s * F.when(cond, x).otherwise(1.0)
        late = {
            "feature": [(many, 0.4)], "fix": [(many, 0.3)], "improve": [(many, 0.3)], "ship": [((col("ships") > 0) & (col("edits") < 0.05), 1.5)], "research": [(col("web") > 0.2, 1.5)],
            "write": [(col("prose") & (col("edits") > 0), 0.6)], "design": [(col("visual"), 0.3)],
        }
        for cond, x in late.get(k, []):
            s = s + F.when(cond, x).otherwise(0.0)
        return s

    scored = out.withColumn("all", F.array(*[F.struct(F.round(score(k), 6).alias("score"), F.lit(-i).alias("order"), F.lit(k).alias("kind")) for i, k in enumerate(KINDS)]))
    ranked = scored.withColumn("ranked", F.reverse(F.array_sort("all"))).withColumn("total", F.aggregate("all", F.lit(0.0), lambda a, x: a + x["score"]))
    top, second = col("ranked")[0], col("ranked")[1]
    raw = 0.35 + 0.4 * (top["score"] - second["score"]) / top["score"] + 0.25 * F.least(F.lit(1.0), top["score"] / 3) - F.when(col("total") > 12, 0.05).otherwise(0.0)
    sure = F.floor(F.greatest(F.lit(0.2), F.least(F.lit(0.95), raw)) * 100 + 0.5 + 1e-9) / 100
    follow = col("ask").rlike(FOLLOW_UP) & (F.length("ask") < 80)
    weak = top["score"] < 0.8
    return ranked.select(
        "piece_id", F.when(follow, "follow_up").when(weak, "other").otherwise(top["kind"]).alias("work_type"), F.when(follow, 0.3).when(weak, 0.2).otherwise(sure).alias("confidence"),
        F.when(~follow & ~weak & (second["score"] > 0), second["kind"]).alias("runner_up"),
    )


def classify_sql(rows: str) -> str:
    """``classify`` over the relation ``rows`` as SQL text."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    leads = "MAP {" + ", ".join(f"{q(w)}: {q(k)}" for w, k in LEAD.items()) + "}"
    still, many = "(edits = 0 AND (reads > 0.3 OR n <= 2))", "(edits > 0.25)"
    when = lambda c, x: f"CASE WHEN {c} THEN {x}::DOUBLE ELSE 0.0::DOUBLE END"
    by = lambda c, x: f"CASE WHEN {c} THEN {x}::DOUBLE ELSE 1.0::DOUBLE END"

    def score(k: str) -> str:
        hits = f"len(regexp_extract_all(head, {q(PATTERNS[k])}))"
        s = f"(CASE WHEN {hits} > 0 THEN 0.6::DOUBLE + 0.4::DOUBLE * least(2, {hits} - 1) ELSE 0.0::DOUBLE END + {when(f'lead = {q(k)}', 2.2)}"
        s += {"fix": f" + {when(f'regexp_matches(ask, {q(PASTED)})', 2.2)} + {when(f'regexp_matches(head, {q(REPORT)})', 1.4)}", "routine": " + " + when(f"regexp_matches(ask, {q(PATTERNS['routine'])})", 6.0), "investigate": f" + {when(still, 1.2)}", "review": f" + {when(still, 0.6)}"}.get(k, "") + ")"
        s += {"fix": f" * {by(still, 0.7)}", "feature": f" * {by(still, 0.6)}", "investigate": f" * {by(many, 0.6)}"}.get(k, "")
        return s + {"feature": f" + {when(many, 0.4)}", "fix": f" + {when(many, 0.3)}", "improve": f" + {when(many, 0.3)}", "ship": f" + {when('ships > 0 AND edits < 0.05', 1.5)}", "research": f" + {when('web > 0.2', 1.5)}", "write": f" + {when('prose AND edits > 0', 0.6)}", "design": f" + {when('visual', 0.3)}"}.get(k, "")

    all_ = ", ".join(f"struct_pack(score := round({score(k)}, 6), \"order\" := {-i}, kind := {q(k)})" for i, k in enumerate(KINDS))
    return f"""SELECT piece_id, CASE WHEN follow THEN 'follow_up' WHEN r[1].score < 0.8 THEN 'other' ELSE r[1].kind END AS work_type,
        CASE WHEN follow THEN 0.3::DOUBLE WHEN r[1].score < 0.8 THEN 0.2::DOUBLE ELSE floor(greatest(0.2::DOUBLE, least(0.95::DOUBLE, 0.35::DOUBLE + 0.4::DOUBLE * (r[1].score - r[2].score) / r[1].score + 0.25::DOUBLE * least(1.0::DOUBLE, r[1].score / 3) - CASE WHEN total > 12 THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END)) * 100 + 0.5::DOUBLE + 1e-9::DOUBLE) / 100 END AS confidence,
        CASE WHEN NOT follow AND r[1].score >= 0.8 AND r[2].score > 0 THEN r[2].kind END AS runner_up FROM
        (SELECT *, list_sort(sc, 'DESC') AS r, list_sum(list_transform(sc, lambda x: x.score)) AS total, regexp_matches(ask, {q(FOLLOW_UP)}) AND length(ask) < 80 AS follow FROM
        (SELECT *, [{all_}] AS sc FROM (SELECT *, left(ask, 400) AS head, coalesce({leads}[regexp_extract(lower(regexp_replace(ask, {q(OPENER)}, '')), '^[^a-z]*([a-z]+)', 1)], '') AS lead FROM {rows})))"""
