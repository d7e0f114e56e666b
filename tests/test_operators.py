import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.functions.rules import first_rule, first_rule_sql
from weftline.operators import measures as M
from weftline.operators import pieces as P
from weftline.operators.graph import connected_components
from weftline.operators.stage import salted_left_join, written
from weftline.operators.threads import Machine, Thread


def one(spark, value, column, t="string"):
    return spark.createDataFrame([(value,)], f"t {t}").select(column(F.col("t")).alias("x")).first()["x"]


def test_rules(spark):
    rules = [("a", {"x": "^a", "y": "1"}), ("b", {"x": "^[ab]"})]
    df = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", None), ("c", None), (None, None)], "x string, y string")
    assert [r.v for r in df.select(first_rule(rules, "z").alias("v")).collect()] == ["a", "b", "b", "z", "z"]
    assert "CASE WHEN" in first_rule_sql(rules) and df.select(first_rule([], "q").alias("v")).first().v == "q"


def test_texts(spark):
    assert one(spark, "## Do <b>this</b>. Then that.", X.first_sentence) == "Do this ."
    assert one(spark, "x" * 100, X.first_sentence) == "x" * 71 + "…"
    assert one(spark, None, X.first_sentence) is None and one(spark, "", X.first_sentence) == ""
    assert one(spark, "See https://a.b/c the src/x.py, 42 and Zed!", X.tokens) == ["see", "src/x.py", "zed"]
    assert one(spark, "Exit code 1\nError: no '/tmp/a/b.ts' at deadbeef01, 12 times", lambda c: X.error_signature(F.lit("bash"), c)) == 'bash: no "…" at <id>, n times'
    assert one(spark, "short", lambda c: X.error_signature(F.lit("bash"), c)) is None
    assert one(spark, [1, 2, 3, 4, 5], lambda c: X.head_tail(c, 1, 2), "array<int>") == [1, 4, 5]
    assert one(spark, "key ghp_abcdefghijklmnopqrstuvwxyz and password=hunter22", X.redact) == "key [redacted:github_token] and [redacted:assigned]"
    assert one(spark, "nothing here", X.redact) == "nothing here"
    assert one(spark, "abab", X.entropy) == 1.0 and one(spark, "", X.entropy) == 0.0 and one(spark, None, X.entropy) is None


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert connected_components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_salted_join_is_a_left_join(spark):
    left = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 0), (None, 9)], "k int, v int")
    right = spark.createDataFrame([(1, "a"), (3, "c")], "k int, w string")
    got = salted_left_join(left, right, ["k"])
    assert got.count() == 52 and got.where("w = 'a'").count() == 50 and got.where("w is null").count() == 2
    assert sorted(map(tuple, written(left).collect()), key=str) == sorted(map(tuple, left.collect()), key=str)


def test_lcg_and_bootstrap():
    x, want = 7, []
    for _ in range(1000):
        x = (x * 1664525 + 1013904223) % 2**32
        want.append(x / 2**32)
    assert M.lcg(7, 1000).tolist() == want and M.lcg(7, 0).size == 0
    same = np.arange(10.0)
    d, lo, hi = M.bootstrap(same, same)
    assert d == 0 and lo <= 0 <= hi and M.bootstrap(same, same) == (d, lo, hi)
    d, lo, hi = M.bootstrap(np.arange(1.0, 6), np.arange(6.0, 11))
    assert d == 5 and lo > 0


def test_compare_groups(spark):
    rows = [("a", k >= 6, float(k)) for k in range(12)] + [("few", False, 1.0)] + [("a", True, None)]
    got = M.compare_groups(spark.createDataFrame(rows, "grp string, after boolean, value double")).collect()
    assert [(r.grp, r.n_before, r.n_after, r.detectable) for r in got] == [("a", 6, 6, True)]


def test_packing():
    import pandas as pd

    lanes = pd.concat(M.pack_lanes([pd.DataFrame({"grp": ["x"] * 4, "a": [0, 1, 5, 6], "b": [4, 5, 9, 7]})]))
    assert lanes["lane"].tolist() == [0, 1, 0, 1]
    bins = pd.concat(M.pack_bins([pd.DataFrame({"grp": ["x"] * 4 + ["y"], "size": [3, 3, 9, 1, 1]})], 6))
    assert bins["bin"].tolist() == [0, 0, 1, 2, 0]


def test_fnv_and_trees(spark):
    def fnv(s):
        h = 2166136261
        for c in s.encode():
            h = ((h ^ c) * 16777619) % 2**32
        return h

    for s in ("", "a", "w:hello"):
        assert one(spark, s, M.fnv1a) == fnv(s)
    tree = {"feature": ["t", "", ""], "threshold": [2, 0, 0], "left": [1, -1, -1], "right": [2, -1, -1], "value": [0, 1.0, -1.0]}
    assert one(spark, 2, lambda c: M.tree_score([tree], 1.0), "int") == pytest.approx(1 / (1 + math.exp(-1)))


def test_query_language(spark):
    assert P.parse_query('outcome:shipped "two words" conf:>=0.8 foo:bar session:"a b"') == ({"outcome": "shipped", "conf": ">=0.8", "session": "a b"}, "two words foo:bar")
    df = spark.createDataFrame([("shipped_checked", 0.9), ("open", None), ("open", 0.2)], "outcome string, confidence double")
    assert P.where_query(df, {"conf": ">0.5"}).count() == 2 and P.where_query(df, {"outcome": "ship"}).count() == 1 and P.where_query(df, {"conf": "x"}).count() == 3


def test_search_ranks_more_terms_first(spark):
    ix = spark.createDataFrame([("d1", "summary", "alpha"), ("d1", "summary", "beta"), ("d2", "summary", "alpha"), ("d3", "actions", "alpha"), ("d4", "summary", "gamma")], "doc string, field string, term string")
    assert [r.doc for r in P.search(ix, ["alpha", "beta"]).collect()][0] == "d1"
    assert P.search(ix, ["none"]).count() == 0 and P.search(ix, []).count() == 0


class Ev:
    def __init__(self, i, kind, move=None, **kw):
        self.i, self.kind, self.move, self.lane, self.tool, self.target, self.title, self.claim = i, kind, move, kw.get("lane"), kw.get("tool", "Bash"), kw.get("target", ""), kw.get("title", ""), kw.get("claim")
        for f in ("err", "denied", "rejected", "continues", "corrects", "after_rejection", "finds", "plans", "leaves", "gives_up", "slip"):
            setattr(self, f, kw.get(f, False))


def machine(events):
    m = Machine("s")
    for e in events:
        m.feed(e)
    return m


def test_recovery_hands_back_after_a_check():
    m = machine([
        Ev(0, "ask"), Ev(1, "tool", "X", lane="run", err=True, target="a"), Ev(2, "tool", "X", lane="check", err=True, target="b"), Ev(3, "tool", "c", lane="change", tool="Edit", target="f"),
        Ev(4, "tool", "h", lane="check", target="pytest"), Ev(5, "tool", "s", lane="ship", target="git push", claim="PR #4"),
    ])
    home, detour = m.threads
    assert (detour.origin, detour.kind, detour.home.no) == ("surprise", "recovery", 1)
    assert "".join(home.moves) == "XXs" and "".join(detour.moves) == "ch" and detour.settled and home.claims == ["PR #4"]
    assert home.spans == [[0, 1], [4, 5]] and detour.spans == [[2, 3]]
    assert home.status(True) == "outcome" and detour.root() is home


def test_wall_opens_once_and_hands_back():
    m = machine([Ev(0, "ask"), Ev(1, "tool", "D", lane="probe", err=True, denied=True), Ev(2, "tool", "p", lane="probe"), Ev(3, "tool", "D", lane="probe", err=True, denied=True)])
    assert [t.kind for t in m.threads] == [None, "wall"] and "".join(m.threads[0].moves) == "pD" and "".join(m.threads[1].moves) == "D"


def test_rejection_is_no_wall_and_its_reason_stays():
    m = machine([Ev(0, "ask"), Ev(1, "tool", "D", lane="run", err=True, denied=True, rejected=True), Ev(2, "ask", after_rejection=True), Ev(3, "ask", continues=True), Ev(4, "ask")])
    assert len(m.threads) == 2 and m.threads[0].spans == [[0, 3]]


def test_agent_opens_found_plan_and_gives_up():
    m = machine([Ev(0, "say"), *[Ev(i, "tool", "p", lane="probe") for i in range(1, 9)], Ev(9, "say", plans=True), Ev(10, "say", gives_up=True)])
    assert [t.origin for t in m.threads] == ["agent", "plan"] and m.threads[1].root().no == 1 and m.threads[1].blocked
    m = machine([Ev(0, "ask"), *[Ev(i, "tool", "p", lane="probe") for i in range(1, 5)], Ev(5, "say", finds=True)])
    assert m.threads[1].kind == "found"


def test_status_cascade_and_empty_session():
    t = Thread(1, "ask", "", 0, moves=list("pcXX"))
    assert t.status(True) == "abandoned" and Thread(1, "ask", "", 0).status(True) == "open" and Thread(1, "ask", "", 0, moves=list("hcp")).status(False) == "outcome"
    assert machine([]).rows() == [] and json.dumps(machine([Ev(0, "ask")]).rows())


def test_evidence_is_whole(spark):
    from weftline.plans.extra import evidence

    long = "word " * 200 + "the end of the message"
    row = lambda i, kind, full=None, err=None, r=None: ("s", i, kind, None, i, 1, full and full[:600], full, "Bash" if kind == "tool" else None, "ls" if kind == "tool" else None, err, False if kind == "tool" else None, r)
    rows = [row(0, "ask", "first task"), row(1, "say", "a1"), row(2, "say", "a2"), row(3, "say", "a3"), row(4, "say", "a4"), row(5, "ask", "second task"), row(6, "tool", err=True, r="boom broke"), row(7, "say", long), row(8, "tool", err=False, r="fine output"), row(9, "ask", "third task")]
    ev = spark.createDataFrame(rows, "session string, i long, kind string, ts timestamp, row_id long, pos int, text string, full string, tool string, target string, err boolean, denied boolean, r_text string")
    think = spark.createDataFrame([("s", 7, 0, "so it is the disk"), ("s", 99, 0, "too late")], "session string, row_id long, pos int, text string")
    got = {r.piece_id: r.evidence for r in evidence(ev, think, 14_000).collect()}["s:2"].split("\n")
    assert got[:5] == ["[2]~AGENT: a2", "[3]~AGENT: a3", "[4]~AGENT: a4", "[5] PERSON: second task", "[6] TOOL Bash: ls => FAILED: boom broke"]
    assert got[5] == "[r] REASONING: so it is the disk" and got[6].endswith("the end of the message") and got[7] == "[8] TOOL Bash: ls => fine output" and got[8] == "[9]~PERSON: third task"
    assert got[9].startswith("[end] This piece's last event is [8]. The session continued for 1 more") and len(got) == 10


def test_thoughts_of_a_long_session_find_their_event(spark):
    from weftline.plans.extra import evidence

    # Rows far enough apart that events and thoughts stand in many cuts; both sessions hold the same rows.
    r = random.Random(4)
    places = sorted(r.sample([(at * 9_001, pos) for at in range(150) for pos in range(3)], 240))
    thinks = {s: set(r.sample(range(240), 60)) | {70, 71, 72, 239} for s in "st"}
    events, thoughts, want = [], [], {}
    for s, own in thinks.items():
        i, waiting = 0, []
        for n, (row_id, pos) in enumerate(places):
            if n in own:
                thoughts.append((s, row_id, pos, f"{s}{n}"))
                waiting.append(f"{s}{n}")
                continue
            events.append((s, i, "ask" if i % 9 == 0 else "say", None, row_id, pos, f"m{i}", f"m{i}", None, None, None, None, None))
            want |= {t: (f"{s}:{i // 9 + 1}", i, k) for k, t in enumerate(waiting)}
            i, waiting = i + 1, []
    ev = spark.createDataFrame(events, "session string, i long, kind string, ts timestamp, row_id long, pos int, text string, full string, tool string, target string, err boolean, denied boolean, r_text string")
    out = evidence(ev, spark.createDataFrame(thoughts, "session string, row_id long, pos int, text string"), 14_000)
    got = {}
    for x in out.collect():
        waiting = []
        for line in x.evidence.split("\n"):
            if line.startswith("[r] REASONING: "):
                waiting.append(line.removeprefix("[r] REASONING: "))
            elif waiting:
                got |= {t: (x.piece_id, int(line[1 : line.index("]")]), k) for k, t in enumerate(waiting)}
                waiting = []
    assert got == want and "s239" not in got
    # A frame that is open to the end costs the square of a session's rows.
    assert "unboundedfollowing" not in out._jdf.queryExecution().analyzed().toString().lower()


def test_facts_and_acts_read_the_end(spark):
    from weftline.operators import steps as S
    from weftline.operators.events import numbered, outcome_columns

    filler = "line of output. " * 60
    rows = [(0, "tool", None, "npm test", False, filler + "42 passed"), (1, "tool", None, "npm test", False, filler + "3 failed, 42 passed"), (2, "tool", None, "gh pr create", False, filler + "see pull/77"), (3, "say", filler + "Let me know.", "", None, None)]
    df = spark.createDataFrame(rows, "row_id long, kind string, full string, target string, r_err boolean, r_text string")
    df = df.selectExpr("*", "'x' client", "'s' session", "0 pos", "null ts", "left(full, 600) text", "null who", "if(kind = 'tool', 'Bash', null) tool", "null call_id", "kind = 'tool' answered")
    ev = numbered(outcome_columns(df))
    got = [(r.result, r.pr) for r in S.with_facts(ev).where("kind = 'tool'").orderBy("i").collect()]
    assert got == [("pass", None), ("fail", None), ("ok", 77)] and [r.act for r in S.with_acts(ev).collect()] == ["handback"]
