"""What each step was: the lane of a call, its move, its action and result, and the act that a message performs.

Calls are read off tables of tools and command words (``functions.commands``), messages off lists of phrases
(``functions.phrases``); both are compiled to CASE expressions over the normalised events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weftline.functions import phrases as P
from weftline.functions.commands import action_of, lane_of
from weftline.functions.rules import Rule, first_rule
from weftline.functions.text import error_signature

# One letter per lane.
LANE_CODE = {"probe": "p", "run": "r", "change": "c", "check": "h", "ship": "s", "delegate": "d"}
CHECKS = ("test", "typecheck", "lint", "build")

_COUNTED = "(^|[^a-z0-9.]){} ({})($|[^a-z])"
#: Outputs that tell of success and of failure: counts of what passed or failed, and set phrases.
PASSED = "(?i)" + "|".join((_COUNTED.format("[0-9]+", "passed|passing"), _COUNTED.format("0", "errors?|failures?|problems?"), P.words("all tests passed; all test passed; found 0 errors; compiled successfully; build succeeded; build completed; no errors; no issues; no problems; no lint errors").removeprefix("(?i)"), "all [0-9]+ tests? passed", "✓|✔", r"(^|[ \n])ok *$"))
FAILED = "|".join((_COUNTED.format("[1-9][0-9]*", "failed|failing|errors?"), r"(^|[^A-Za-z])FAIL($|[^A-Za-z])", "error TS[0-9]+", "✗|✘", "[Bb]uild failed", "Command failed"))
PR = r"(?:pull/|PR #|#)([0-9]{1,6})"
CODE = r"\.(ts|tsx|js|jsx|mjs|cjs|py|go|rs|java|kt|rb|php|cs|swift|c|cc|cpp|h|hpp|sql|vue|svelte|sh)($|[^a-z])"

#: What a message does, first match wins.
ACTS: list[Rule] = [(act, {"text": P.either(*lists)}) for act, lists in P.ACTS.items()]

#: Judgments of the person.
JUDGMENTS: list[Rule] = [("explicit_rule", {"text": P.words(P.RULES)}), ("correction", {"text": P.either(*P.CORRECTIONS)})]

#: Named walls, first match wins: denials by what was called, then errors by what they say.
WALLS: list[Rule] = [
    ("context-unavailable", {"tool": "(?i)^mcp__.*context", "denied_text": "^no$"}),
    ("codex-sandbox", {"denied_text": "^yes$", "client": "^codex$"}),
    ("denied-home", {"denied_text": "^yes$", "target": r"\.claude/"}),
    ("denied-chain", {"denied_text": "^yes$", "tool": "(?i)^bash$", "target": r"&&|\|\||;|(^|[^a-z])(for|while)($|[^a-z])"}),
    ("denied-gh-api", {"denied_text": "^yes$", "target": P.words("gh api; gh issue; gh run")}),
    ("denied-mcp", {"denied_text": "^yes$", "tool": "(?i)^mcp__"}),
    ("denied-web", {"denied_text": "^yes$", "tool": "(?i)web(fetch|search)"}),
    ("denied-other", {"denied_text": "^yes$"}),
    *[(wall, {"err_text": P.words(said)}) for wall, said in P.WALL_ERRORS.items()],
]
SLIP_TOOL = "(?i)^(edit|multiedit|write|read|computer|navigate|find|toolsearch|skill)$"
SLIP_TEXT = P.words(P.SLIPS)


def lane() -> Column:
    """The lane of a call."""
    return lane_of(F.col("tool"), F.col("target"), action_of(F.col("tool"), F.col("target")))


def move() -> Column:
    """One letter per call: X failed, D denied, otherwise its lane's letter."""
    codes = F.create_map(*[F.lit(x) for kv in LANE_CODE.items() for x in kv])
    return F.when(F.col("denied"), "D").when(F.col("err"), "X").otherwise(F.element_at(codes, F.col("lane")))


def with_moves(events: DataFrame) -> DataFrame:
    """The calls of ``events`` with lane and move."""
    calls = events.where("kind = 'tool'").withColumn("action", action_of(F.col("tool"), F.col("target")))
    return calls.withColumn("lane", lane_of(F.col("tool"), F.col("target"), F.col("action"))).withColumn("move", move())


def with_facts(events: DataFrame) -> DataFrame:
    """``events`` with action, result (pending, denied, fail, pass, ok), code (an edit of code) and pr (a number named) of calls."""
    tool = F.col("kind") == "tool"
    action = F.when(tool, action_of(F.col("tool"), F.col("target")))
    result = F.when(F.col("pending"), "pending").when(F.col("denied"), "denied").when(F.col("err"), "fail").otherwise(F.coalesce("verdict", F.lit("ok")))
    df = events.withColumn("action", action).withColumn("result", F.when(tool, result))
    df = df.withColumn("code", F.coalesce((F.col("action") == "edit") & F.col("target").rlike(CODE), F.lit(False)))
    return df.withColumn("pr", F.when(tool, F.col("named_pr").try_cast("bigint")))


def with_acts(events: DataFrame) -> DataFrame:
    """Messages, with the ``act`` of the event scan: 'ask' for the person, otherwise the first family of phrases that matches, or 'other'."""
    return events.where("kind in ('ask', 'say')")


def judgments(events: DataFrame) -> DataFrame:
    """Signals of judgment: (session, i, signal, text, signal_id), each id once.

    A rejected call is a rejection, with the words after "user said:" as its text; a denied one a denial, once per
    session, tool and first line; a person's text an explicit rule, or a correction if the agent acted before. Texts
    under two characters or beginning with a bracket say nothing.
    """
    w = W.partitionBy("session").orderBy("i")
    acted = F.coalesce(F.max(F.col("kind") == "tool").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(False))
    words = F.regexp_extract("err_text", r"(?s)[Uu]ser said:\s*(.*)$", 1)
    first_line = F.substring_index("err_text", "\n", 1)
    seen = F.row_number().over(W.partitionBy("session", "tool", "denial").orderBy("i"))
    df = events.withColumn("acted", acted).withColumn("denial", F.when(F.col("denied") & ~F.col("rejected"), first_line)).withColumn("nth", seen)
    judged = first_rule(JUDGMENTS)
    usable = (F.col("kind") == "ask") & (F.length(F.trim("text")) >= 2) & ~F.col("text").startswith("[")
    signal = (
        F.when(F.col("rejected"), "rejection").when(F.col("denial").isNotNull() & (F.col("nth") == 1), "denial")
        .when(usable & (judged == "explicit_rule"), "explicit_rule").when(usable & F.col("acted") & (F.length("text") <= 600) & (judged == "correction"), "correction")
    )
    df = df.withColumn("signal", signal).where("signal is not null")
    text = F.when(F.col("signal") == "rejection", words).when(F.col("signal") == "denial", F.col("denial")).otherwise(F.col("text"))
    df = df.select("session", "i", "signal", text.alias("text"))
    return df.withColumn("signal_id", F.substring(F.sha2(F.concat_ws("|", "session", "signal", F.col("i").cast("string"), "text"), 256), 1, 16))


def wall_hits(events: DataFrame) -> DataFrame:
    """(session, i, sig, named, tool, target, sample): failed calls with what they ran into.

    Calls that a person rejected are judgments and hit no wall. A named wall comes from the rule table; otherwise the
    error's signature is the wall, unless the agent only misused its tool.
    """
    calls = events.where("kind = 'tool' and err and not rejected").withColumn("denied_text", F.when(F.col("denied"), "yes").otherwise("no"))
    calls = calls.withColumn("wall", first_rule(WALLS))
    slip = F.coalesce(F.col("tool").rlike(SLIP_TOOL), F.lit(False)) | F.coalesce(F.col("err_text").rlike(SLIP_TEXT), F.lit(False))
    sig = F.coalesce("wall", F.when(~slip, error_signature(F.col("tool"), F.col("err_text"))))
    return calls.withColumn("sig", sig).where("sig is not null").select("session", "i", "row_id", "ts", "sig", F.col("wall").isNotNull().alias("named"), "tool", "target", F.substring("err_text", 1, 200).alias("sample"))
