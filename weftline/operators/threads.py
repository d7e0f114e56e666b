"""Threads and goals of a session.

Which thread an event belongs to depends on all events before it, so threads come from one sequential machine. Phrase
and error tests are done before, as column expressions; the machine sees flags. It reads a partition as a stream sorted
by session and position and holds one session's open threads, never its events. A goal is a root thread with its
detours; outcome and detours of goals are window expressions over the steps it owns.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weftline.functions import phrases as P
from weftline.functions.rules import first_rule
from weftline.functions.text import first_sentence
from weftline.operators import steps as S
from weftline.operators.events import CONTINUE

FOUND, PLAN, LEAVE, GIVE_UP = P.discovery(), P.opening(P.PLANS), P.words(P.LEAVES), P.words(P.GIVES_UP)

FLAGS = ("continues", "corrects", "after_rejection", "finds", "plans", "leaves", "gives_up", "slip")
THREAD = (
    "session string, thread int, origin string, kind string, title string, at bigint, moves string, status string, root int, parent int, blocked boolean, errs int, "
    "claims array<string>, backs array<bigint>, spans array<struct<a: bigint, b: bigint>>"
)


def with_flags(events: DataFrame) -> DataFrame:
    """Events with the flags, lane, move, title and claim that the machine reads."""
    w = W.partitionBy("session").orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    says = lambda p: F.coalesce((F.col("kind") == "say") & F.col("text").rlike(p), F.lit(False))
    asks = F.col("kind") == "ask"
    tool = F.col("kind") == "tool"
    rejected_before = F.last(F.when(F.col("kind") != "say", F.coalesce("rejected", F.lit(False))), ignorenulls=True).over(w)
    slip = F.coalesce(F.col("tool").rlike(S.SLIP_TOOL), F.lit(False)) | F.coalesce(F.col("err_text").rlike(S.SLIP_TEXT), F.lit(False))
    claim = F.coalesce("named_pr", F.lit(""))
    df = events.withColumn("lane", F.when(tool, S.lane())).withColumn("move", F.when(tool, S.move()))
    return df.select(
        "session", "i", "kind", "tool", "target", "lane", "move", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("err", "denied", "rejected")],
        F.coalesce(asks & F.col("text").rlike(CONTINUE), F.lit(False)).alias("continues"), F.coalesce(asks & (first_rule(S.JUDGMENTS) == "correction"), F.lit(False)).alias("corrects"),
        (asks & F.coalesce(rejected_before, F.lit(False))).alias("after_rejection"), says(FOUND).alias("finds"), says(PLAN).alias("plans"), says(LEAVE).alias("leaves"), says(GIVE_UP).alias("gives_up"), slip.alias("slip"),
        F.when(~tool, first_sentence(F.col("text"))).alias("title"), F.when(F.col("lane") == "ship", F.when(claim != "", F.concat(F.lit("PR #"), claim)).otherwise(F.substring("target", 1, 40))).alias("claim"),
    )


@dataclass
class Thread:
    no: int
    origin: str
    title: str
    at: int
    kind: str | None = None
    home: Thread | None = None
    parent: Thread | None = None
    moves: list[str] = field(default_factory=list)
    claims: list[str] = field(default_factory=list)
    backs: list[int] = field(default_factory=list)
    spans: list[list[int]] = field(default_factory=list)
    errs: int = 0
    blocked: bool = False
    settled: bool = False

    def owns(self, i: int) -> None:
        if self.spans and self.spans[-1][1] == i - 1:
            self.spans[-1][1] = i
        else:
            self.spans.append([i, i])

    def root(self) -> Thread:
        seen, t = {self.no}, self
        while (up := t.home or (t.parent if t.origin == "plan" else None)) and up.no not in seen:
            seen.add(up.no)
            t = up
        return t

    def status(self, last: bool) -> str:
        m = "".join(self.moves)
        fails = sum(c in "XD" for c in m)
        tail = m[-6:]
        if self.settled:
            return "outcome"
        if self.blocked and "s" not in m:
            return "abandoned"
        if "s" in m:
            return "outcome"
        change = m.rfind("c")
        if change >= 0 and not any(c in "XD" for c in m[change:]) and "h" in m:
            return "outcome"
        if (len(tail) >= 2 and tail[-1] in "XD" and tail[-2] in "XD") or (m and fails * 2 > len(m)):
            return "abandoned"
        return "open" if last else "outcome?"


class Machine:
    """The threads of one session, fed event by event. Batch and stream use the same machine."""

    def __init__(self, session: str):
        self.session = session
        self.threads: list[Thread] = []
        self.cur: Thread | None = None
        self.asked: Thread | None = None
        self.errors: list[tuple] = []  # the last four: i, lane, tool, target, denied, slip
        self.walled = False

    def _open(self, origin: str, title: str, i: int, kind: str | None = None, home: Thread | None = None) -> Thread:
        t = Thread(len(self.threads) + 1, origin, title, i, kind, home)
        self.threads.append(t)
        self.cur = t
        return t

    def feed(self, e) -> None:
        {"ask": self._ask, "say": self._say, "tool": self._tool}[e.kind](e)
        if self.cur is not None:  # the thread that is current after an event owns it
            self.cur.owns(e.i)

    def _ask(self, e) -> None:
        if self.cur is not None and (e.continues or e.corrects or e.after_rejection):
            return
        self.asked = self._open("ask", e.title or "", e.i)

    def _say(self, e) -> None:
        if self.cur is None:
            self.asked = self._open("agent", e.title or "", e.i)
        cur = self.cur
        if e.finds and len(cur.moves) > 2 and cur.kind != "found":
            self._open("surprise", e.title or "", e.i, "found", (cur.home or cur) if cur.kind == "recovery" else cur)
        elif e.plans and len(cur.moves) > 6 and cur.origin != "surprise":
            self._open("plan", e.title or "", e.i).parent = self.asked
        if e.gives_up:
            self.cur.blocked = True
        if e.leaves and self.errors:
            self.cur.backs.append(e.i)
            self.errors.clear()

    def _tool(self, e) -> None:
        if self.cur is None:
            self.asked = self._open("agent", "", e.i)
        cur = self.cur
        cur.moves.append(e.move)
        last = self.errors[-1] if self.errors else None
        if e.err:
            cur.errs += 1
            self.errors = [*self.errors[-3:], (e.i, e.lane, e.tool, e.target, e.denied, e.slip)]
        elif last and last[1] == e.lane and last[2] == e.tool and last[3] != e.target and e.i - last[0] < 5:
            cur.backs.append(e.i)
            self.errors.clear()
        elif last and e.i - last[0] > 8:
            self.errors.clear()
        if e.lane == "ship" and e.claim:
            cur.claims.append(e.claim)
        if e.denied and not e.rejected and not self.walled and cur.origin != "surprise":
            self.walled = True
            cur.moves.pop()
            self._open("surprise", f"around denied {e.tool} calls", e.i, "wall", cur).moves.append("D")
        elif cur.origin != "surprise" and sum(not x[4] and not x[5] for x in self.errors) >= 2:
            self._open("surprise", f"recover from {e.tool} failures", e.i, "recovery", cur)
            self.errors.clear()
        self._hand_back(e)

    def _hand_back(self, e) -> None:
        cur = self.cur
        if e.err or cur.home is None or cur.origin != "surprise":
            return
        if cur.kind == "wall":
            cur.home.moves.append(cur.moves.pop())
            cur.settled = True
            self.cur = cur.home
        elif len(cur.moves) >= 2:
            if e.lane == "ship":
                cur.home.moves.append(cur.moves.pop())
                if cur.claims:
                    cur.home.claims.append(cur.claims.pop())
                self.cur = cur.home
            elif e.lane == "check" and any(c in "cr" for c in cur.moves[:-1]):
                cur.settled = True
                self.cur = cur.home

    def rows(self) -> list[tuple]:
        kept = [t for t in self.threads if t.moves or t.origin == "ask"]
        return [
            (self.session, t.no, t.origin, t.kind, t.title, t.at, "".join(t.moves), t.status(t is self.cur), t.root().no, t.parent.no if t.parent else None, t.blocked, t.errs,
             list(dict.fromkeys(t.claims))[:3], t.backs, [{"a": a, "b": b} for a, b in t.spans])
            for t in kept
        ]


_COLUMNS = [c.strip().split(" ")[0] for c in ("session s, thread i, origin s, kind s, title s, at b, moves s, status s, root i, parent i, blocked b, errs i, claims a, backs a, spans a").split(",")]


def run_machine(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    machine: Machine | None = None
    for pdf in batches:
        done: list[tuple] = []
        for e in pdf.itertuples(index=False):
            if machine is None or machine.session != e.session:
                if machine is not None:
                    done += machine.rows()
                machine = Machine(e.session)
            machine.feed(e)
        yield _frame(done)
    if machine is not None:
        yield _frame(machine.rows())


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=_COLUMNS)
    out["parent"] = out["parent"].astype("Int32")
    return out


def threads(events: DataFrame) -> DataFrame:
    """The threads of every session. A task streams the sessions of its partition; memory is one session's threads."""
    flagged = with_flags(events)
    n = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return flagged.repartition(n, "session").sortWithinPartitions("session", "i").mapInPandas(run_machine, THREAD)


def goal_steps(events: DataFrame, threads_: DataFrame) -> DataFrame:
    """Steps with the goal (root thread) that owns them, their facts and acts, and their session's last position."""
    own = threads_.select("session", "root", F.explode("spans").alias("s")).select("session", "root", F.explode(F.sequence("s.a", "s.b")).alias("i"))
    ev = S.with_facts(events).withColumn("act", F.when(F.col("kind") == "say", F.col("act"))).withColumn("final_i", F.max("i").over(W.partitionBy("session")))
    return ev.join(own, ["session", "i"])


# Status of an outcome and how sure it is.
OUTCOMES = {
    "shipped_checked": ("done", 0.95),
    "shipped_unchecked": ("done", 0.85),
    "verified_change": ("done", 0.85),
    "blocked_reported": ("parked", 0.8),
    "blocked_wall": ("dropped", 0.8),
    "handed_back": ("parked", 0.75),
    "open": ("open", 0.7),
    "answered": ("done", 0.6),
    "reported_change": ("done", 0.6),
    "abandoned": ("dropped", 0.55),
    "unclear": ("unclear", 0.2),
}


def goal_outcomes(steps: DataFrame) -> DataFrame:
    """(session, root, outcome, status, confidence, checked_after_change, n_steps) of each goal, by a cascade over its steps."""
    tool, say = F.col("kind") == "tool", F.col("kind") == "say"
    check = tool & F.col("action").isin("test", "typecheck", "lint", "build")
    passed = check & (F.col("result") == "pass")
    ship = tool & F.col("action").isin("ship", "deploy") & F.col("result").isin("ok", "pass")
    g = W.partitionBy("session", "root")
    at = lambda c: F.max(F.when(c, F.col("i"))).over(g)
    back = F.row_number().over(W.partitionBy("session", "root", tool).orderBy(F.desc("i")))
    df = steps.withColumn("change_at", at(tool & F.col("action").isin("edit", "commit"))).withColumn("code_at", at(F.col("code"))).withColumn("ship_at", at(ship)).withColumn("say_at", at(say)).withColumn("tool_at", at(tool)).withColumn("back", back)
    bad = tool & (F.col("back") <= 4) & F.col("result").isin("denied", "fail")
    a = df.groupBy("session", "root").agg(
        *[F.max(c).alias(c) for c in ("change_at", "code_at", "ship_at", "say_at", "tool_at", "final_i")], F.max("i").alias("last_i"), F.count("*").alias("n_steps"),
        F.max(passed & (F.col("i") > F.col("change_at"))).alias("verified"), F.max(passed & (F.col("i") < F.col("ship_at")) & (F.col("i") >= F.coalesce("change_at", F.lit(-1)))).alias("ship_checked"),
        F.max(check & ~F.col("result").isin("fail", "denied") & (F.col("i") > F.col("code_at"))).alias("checked_after_change"), F.count_if(tool & (F.col("back") <= 4)).alias("tail"), F.count_if(bad).alias("tail_bad"),
        F.max(bad & (F.col("result") == "denied")).alias("tail_denied"), F.max_by("act", F.when(say, F.col("i"))).alias("final_act"), F.max_by(F.length("text"), F.when(say, F.col("i"))).alias("final_size"),
    )
    ends_on_tool = F.col("tool_at").isNotNull() & (F.col("say_at").isNull() | (F.col("tool_at") > F.col("say_at")))
    speaks = F.col("say_at").isNotNull() & ~ends_on_tool
    ends = F.col("last_i") == F.col("final_i")
    changed, verified = F.col("change_at").isNotNull(), F.coalesce("verified", F.lit(False))
    blocked = F.coalesce(F.col("final_act") == "blocked", F.lit(False)) | ((F.col("tail") >= 2) & (F.col("tail_bad") == F.col("tail")))
    long_ = F.coalesce(F.col("final_size") > 160, F.lit(False))
    outcome = (
        F.when(F.col("ship_at").isNotNull(), F.when(F.coalesce("ship_checked", F.lit(False)), "shipped_checked").otherwise("shipped_unchecked"))
        .when(F.col("final_act") == "handback", "handed_back")
        .when(blocked, F.when(speaks, "blocked_reported").when(F.coalesce("tail_denied", F.lit(False)), "blocked_wall").otherwise("abandoned"))
        .when(ends & ends_on_tool, "open")
        .when(speaks & long_, F.when(~changed, "answered").when(verified, "verified_change").otherwise("reported_change"))
        .when(verified, "verified_change").when(~changed & long_, "answered")
        .when(F.col("final_act").isin("claim_done", "verification"), F.when(changed, "verified_change").otherwise("answered"))
        .otherwise(F.when(ends, "open").otherwise("unclear"))
    )
    pick = lambda k: F.element_at(F.create_map(*[F.lit(x) for o, v in OUTCOMES.items() for x in (o, v[k])]), F.col("outcome"))
    return a.withColumn("outcome", outcome).select("session", "root", "outcome", pick(0).alias("status"), pick(1).alias("confidence"), F.when(F.col("code_at").isNotNull(), F.coalesce("checked_after_change", F.lit(False))).alias("checked_after_change"), "n_steps")


def backtracks(steps: DataFrame) -> DataFrame:
    """(session, root, i, trigger): changes of course, at most one within three positions; the suppression is greedy, so it is a fold."""
    w = W.partitionBy("session", "root").orderBy("i")
    near = w.rowsBetween(-4, -1)
    had = lambda c: F.coalesce(F.max(c).over(near), F.lit(False))
    first_ask = F.row_number().over(W.partitionBy("session", "root", "kind").orderBy("i"))
    before = F.last(F.when(F.col("kind") != "say", F.coalesce("rejected", F.lit(False))), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    trigger = F.when(had(F.col("rejected")), "person").when(had(F.col("result") == "fail"), "error").when(had(F.col("result") == "denied"), "denied").when(had(F.col("kind") == "ask"), "person").otherwise("evidence")
    corrected = (F.col("kind") == "ask") & (F.col("nth") > 1) & (F.coalesce(first_rule(S.JUDGMENTS) == "correction", F.lit(False)) | F.coalesce("after", F.lit(False)))
    df = steps.withColumn("nth", first_ask).withColumn("after", before).withColumn("why", trigger)
    cand = df.where(corrected | (F.col("act") == "course_change")).select("session", "root", "i", F.when(F.col("kind") == "ask", "person").otherwise(F.col("why")).alias("trigger"), (F.col("kind") == "ask").alias("asked"))
    listed = cand.groupBy("session", "root").agg(F.array_sort(F.collect_list(F.struct("i", "trigger", "asked"))).alias("all"))

    def keep(acc, x):
        near_last = (F.size(acc) > 0) & (x["i"] - F.element_at(acc, -1)["i"] <= 2)
        drop = near_last & (~x["asked"] | (F.element_at(acc, -1)["trigger"] == "person"))
        return F.when(drop, acc).otherwise(F.concat(acc, F.array(x)))

    empty = F.filter("all", lambda x: F.lit(False))
    return listed.select("session", "root", F.explode(F.aggregate("all", empty, keep)).alias("b")).select("session", "root", "b.i", "b.trigger")
