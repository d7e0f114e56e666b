import json
import os
import random
from collections import defaultdict

from pyspark.sql import functions as F

from weftline.functions import commands, phrases
from weftline.operators import events as E
from weftline.operators import secrets
from weftline.operators import steps as S
from weftline.operators import threads as T
from weftline.operators.stage import running
from weftline.sources import sinks
from weftline.sources.tables import table
from weftline.streaming.tail import Backoff, ByteTail, SingleFlight


def test_running_values_over_many_cuts(spark):
    r = random.Random(2)
    rows = [(r.choice(["hot"] * 6 + ["a", "b", None]), i, r.choice([1, 2, None]), "clash") for i in range(400)]
    df = spark.createDataFrame(rows, "k string, at long, v long, n string")
    for before in (False, True):
        got = {x["at"]: (x["s"], x["l"]) for x in running(df, "k", "at", ["at"], sums={"s": F.col("v")}, lasts={"l": F.col("v")}, before=before, width=7).where("k is not null").collect()}
        total, last, want = defaultdict(int), {}, {}
        for k, at, v, _ in rows:
            if k is None:
                continue
            if before:
                want[at] = (total[k], last.get(k))
            total[k] += v or 0
            last[k] = v if v is not None else last.get(k)
            if not before:
                want[at] = (total[k], last.get(k))
        assert got == want
    assert running(df.where("false"), "k", "at", ["at"], sums={"s": F.col("v")}).count() == 0


def test_actions_and_lanes(spark):
    cases = {
        ("Bash", "cd web && npm run test -- x"): ("test", "check"), ("Bash", "git push origin main"): ("ship", "ship"), ("Bash", "sudo FOO=1 ./node_modules/.bin/x"): ("run", "run"), ("bash", "git log; git commit -m x"): ("commit", "ship"), ("Bash", "sleep 5 && gh run view 3"): ("git_read", "probe"),
        ("Edit", "git push"): ("edit", "change"), ("Grep", "pytest"): ("search", "probe"), ("mcp__db__execute_sql", "select 1"): ("mcp", "probe"), ("mcp__db__execute_sql", "drop table x"): ("mcp", "change"), ("mcp__browser__click", ""): ("web", "check"), ("Task", ""): ("delegate", "delegate"), ("WebFetch", "u"): ("web", "probe"), (None, None): ("run", "run"),
    }
    df = spark.createDataFrame([(*k, i) for i, k in enumerate(cases)], "tool string, target string, n int")
    a = commands.action_of(F.col("tool"), F.col("target"))
    got = {r.n: (r.a, r.l) for r in df.select("n", a.alias("a"), commands.lane_of(F.col("tool"), F.col("target"), a).alias("l")).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def test_phrases(spark):
    hit = lambda p, t: spark.range(1).select(F.lit(t).rlike(p).alias("x")).first().x
    assert hit(phrases.words("can't read; tests pass*"), "I CAN’T read it") and hit(phrases.words("tests pass*"), "the tests passed.") and not hit(phrases.words("done"), "undone")
    assert hit(phrases.opening("done"), " Done: x") and not hit(phrases.opening("done"), "it is done") and hit(phrases.discovery(), "I noticed that there is a small leak here") and not hit(phrases.discovery(), "found the file. There is no bug")


def test_records_without_uuid_are_their_own(spark):
    block = "struct<type: string, text: string, thinking: string, id: string, name: string, input: string, tool_use_id: string, content: string, is_error: boolean>"
    b = {"type": "text", "text": "hi", **dict.fromkeys(("thinking", "id", "name", "input", "tool_use_id", "content", "is_error"))}
    rows = [(i, u, "s", False, None, {"role": "user", "content": [b]}) for i, u in enumerate([None, None, "a", "a"])]
    df = spark.createDataFrame(rows, f"row_id long, uuid string, sessionId string, isSidechain boolean, ingested_at timestamp, message struct<role: string, content: array<{block}>>")
    assert sorted(r.i for r in E.chat_events(df).collect()) == [0, 1, 2]


def test_secrets(spark):
    tok = "ghp_" + "aB3dE6gH9jK2mN5pQ8sT1vW4yZ7cF0hJ3lM6"
    assert secrets.find_secrets(f"x {tok} y") == [(2, 42, "github_token")]
    assert secrets.redacted("api_key = 'q8Zr2LkP0xVt5Nw7'") == "api_key = '[redacted:assigned]'" and secrets.redacted("password = ${DB_PASSWORD}") == "password = ${DB_PASSWORD}"
    assert secrets.redacted("token=aaaaaaaaaaaaaaaa") == "token=aaaaaaaaaaaaaaaa" and secrets.redacted(None) is None and secrets.redacted("") == ""  # too little entropy
    assert secrets.redacted(f"Authorization: Bearer {tok}") == "Authorization: Bearer [redacted:authorization]"  # the longest of those that begin first
    assert secrets.redacted("https://me:pa55w0rd!@h.test/x") == "https://me:[redacted:url_password]@h.test/x"
    df = spark.createDataFrame([(1, f"a {tok}", {"t": f"b {tok}", "n": 3}, [tok, "plain"]), (2, None, None, None), (3, "plain", {"t": "x", "n": 1}, [])], "id int, s string, o struct<t: string, n: int>, l array<string>")
    got = {r.id: r for r in secrets.redact_rows(df).collect()}
    assert (got[1].s, got[1].o.t, got[1].o.n, got[1].l) == ("a [redacted:github_token]", "b [redacted:github_token]", 3, ["[redacted:github_token]", "plain"])
    assert got[2].s is None and got[2].o is None and got[2].l is None and got[3].s == "plain" and got[3].l == []


def test_byte_tail(tmp_path):
    p = tmp_path / "x.jsonl"
    t = ByteTail(str(p))
    assert t.read() == []
    text = "eins\nzwei é".encode()
    p.write_bytes(text[:-1])  # cut inside a character
    assert t.read() == ["eins"] and t.read() == []
    with p.open("ab") as f:
        f.write(text[-1:] + b"\ndrei\n")
    assert t.read() == ["zwei é", "drei"] and t.resets == 0
    p.write_bytes(b"neu\n")  # cut
    assert t.read() == ["neu"] and t.resets == 1
    p.write_bytes(b"neo\n")  # same size, other text
    assert t.read() == ["neo"] and t.resets == 2
    other = tmp_path / "y"
    other.write_bytes(b"neo\nmore\n")
    os.replace(other, p)  # another file
    assert t.read() == ["neo", "more"] and t.resets == 3
    p.write_bytes(b"neo\nmore\n" + b"l" * 5000 + b"\n")
    assert t.read(most=64) == ["l" * 5000]


def test_backoff_and_single_flight():
    b = Backoff()
    assert [b.after_failure() for _ in range(8)] == [1, 2, 4, 8, 16, 32, 60, 60] and b.after_limit(5) == 5 and b.after_limit(99) is None and b.after_limit(1) is None
    b.success()
    assert b.after_failure() == 1 and b.after_limit(1) == 1
    seen = []
    flight = SingleFlight(lambda: (seen.append(1), flight.poke() if len(seen) < 3 else None))
    flight.poke()
    assert len(seen) == 3 and flight.runs == 3 and not flight.busy


def test_batches_fall_back_to_rows():
    got, waits, calls = [], [], []

    def send(rows):
        calls.append(len(rows))
        if len(calls) == 1:
            raise OSError
        if len(calls) == 2:
            raise sinks.Limited(3)
        if any(r["k"] == "bad" for r in rows):
            raise sinks.Refused
        got.extend(r["k"] for r in rows)

    taken = sinks.send_batch([{"k": "a"}, {"k": "bad"}, {"k": "c"}], send, waits.append)
    assert got == ["a", "c"] and [r["k"] for r in taken] == ["a", "c"] and waits == [1.0, 3]


def test_snapshot_and_export(spark, tmp_path):
    df = spark.createDataFrame([(i, f"token = 'q8Zr2LkP0xVt5Nw{i}'") for i in range(5)], "at int, t string")
    path = f"file://{tmp_path}/s"
    sinks.snapshot(df.limit(2), path)
    old = sinks.current(spark, path)
    sinks.snapshot(df, path)
    assert sinks.current(spark, path).count() == 5 and old.count() == 2
    sinks.export_json(df, f"file://{tmp_path}/e", "at", 3)
    rows = [json.loads(x) for f in (tmp_path / "e").glob("*.json") for x in f.read_text().splitlines()]
    assert sorted(r["at"] for r in rows) == [2, 3, 4] and all("redacted" in r["t"] for r in rows)


def fold(events):
    """The threads of one session by the rules as written down, one event after the other, in plain dictionaries."""
    ts, cur, asked, ring, walled = [], None, None, [], False

    def opened(origin, kind=None, home=None, parent=None):
        ts.append({"no": len(ts), "origin": origin, "kind": kind, "home": home, "parent": parent, "m": "", "own": [], "blocked": False, "settled": False, "backs": [], "claims": []})
        return len(ts) - 1

    for e in events:
        if e.kind == "ask":
            if cur is None or not (e.continues or e.corrects or e.after_rejection):
                cur = asked = opened("ask")
        elif e.kind == "say":
            if cur is None:
                cur = asked = opened("agent")
            t = ts[cur]
            if e.finds and len(t["m"]) > 2 and t["kind"] != "found":
                home = t["home"] if t["kind"] == "recovery" and t["home"] is not None else cur
                cur = opened("surprise", "found", home)
            elif e.plans and len(t["m"]) > 6 and t["origin"] != "surprise":
                cur = opened("plan", parent=asked)
            ts[cur]["blocked"] |= e.gives_up
            if e.leaves and ring:
                ts[cur]["backs"].append(e.i)
                ring = []
        else:
            if cur is None:
                cur = asked = opened("agent")
            t = ts[cur]
            t["m"] += e.move
            if e.err:
                ring = (ring + [e])[-4:]
            elif ring:
                x = ring[-1]
                if (x.lane, x.tool) == (e.lane, e.tool) and x.target != e.target and e.i - x.i < 5:
                    t["backs"].append(e.i)
                    ring = []
                elif e.i - x.i > 8:
                    ring = []
            if e.lane == "ship" and e.claim:
                t["claims"].append(e.claim)
            if e.denied and not e.rejected and not walled and t["origin"] != "surprise":
                walled, t["m"], home = True, t["m"][:-1], cur
                cur = opened("surprise", "wall", home)
                ts[cur]["m"] = "D"
            elif t["origin"] != "surprise" and len([x for x in ring if not x.denied and not x.slip]) > 1:
                cur, ring = opened("surprise", "recovery", cur), []
            t = ts[cur]
            if not e.err and t["origin"] == "surprise" and t["home"] is not None:
                home = ts[t["home"]]
                if t["kind"] == "wall":
                    home["m"], t["m"], t["settled"], cur = home["m"] + t["m"][-1], t["m"][:-1], True, t["home"]
                elif len(t["m"]) > 1 and e.lane == "ship":
                    home["m"], t["m"], cur = home["m"] + t["m"][-1], t["m"][:-1], t["home"]
                    if t["claims"]:
                        home["claims"].append(t["claims"].pop())
                elif len(t["m"]) > 1 and e.lane == "check" and set(t["m"][:-1]) & set("cr"):
                    t["settled"], cur = True, t["home"]
        if cur is not None:
            ts[cur]["own"].append(e.i)
    out = []
    for t in ts:
        if t["m"] or t["origin"] == "ask":
            m, fails = t["m"], sum(c in "XD" for c in t["m"])
            if t["settled"] or ("s" in m):
                status = "outcome"
            elif t["blocked"]:
                status = "abandoned"
            elif "c" in m and "h" in m and not set(m[m.rindex("c"):]) & set("XD"):
                status = "outcome"
            elif (len(m) > 1 and set(m[-2:]) <= set("XD")) or fails * 2 > len(m) > 0:
                status = "abandoned"
            else:
                status = "open" if t["no"] == cur else "outcome?"
            out.append((t["no"] + 1, t["origin"], t["kind"], m, status, tuple(t["backs"]), tuple(dict.fromkeys(t["claims"]))[:3], tuple(t["own"])))
    return out


def test_threads_are_those_of_the_plain_fold(spark, data):
    ev = E.chat_events(table(spark, data, "claude"))
    by = defaultdict(list)
    for e in T.with_flags(ev).orderBy("session", "i").collect():
        by[e.session].append(e)
    got = defaultdict(list)
    for t in T.threads(ev).orderBy("session", "thread").collect():
        got[t.session].append((t.thread, t.origin, t.kind, t.moves, t.status, tuple(t.backs), tuple(t.claims), tuple(i for s in t.spans for i in range(s.a, s.b + 1))))
    assert got == {s: x for s, es in by.items() if (x := fold(es))}


def test_outputs_are_read_to_their_end(spark):
    assert S.PASSED and "x" * 10_000 + "\n42 passed" and spark.createDataFrame([("x " * 10_000 + "\n42 passed",)], "t string").where(F.col("t").rlike(S.PASSED) & ~F.col("t").rlike(S.FAILED)).count() == 1
