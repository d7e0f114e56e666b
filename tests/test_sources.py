import gzip
import json
import sqlite3
import uuid

from pyspark.sql import functions as F

from tests.compare import rows
from weftline.operators.events import chat_events, rollout_events, store_events
from weftline.plans import streams, work
from weftline.operators import pieces
from weftline.sources import files, sinks, sqlite
from weftline.streaming import live


def write(path, records):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in records) + "\n")


def chat(role, content, n, **kw):
    return {"type": role, "uuid": f"u{n}", "timestamp": f"2026-01-01T00:00:{n:02d}Z", "sessionId": "s1", "isSidechain": False, "message": {"role": role, "content": content}} | kw


CHAT = [
    chat("user", "Fix the flaky test, please", 0), chat("assistant", [{"type": "text", "text": "Looking."}, {"type": "tool_use", "id": "t1", "name": "Bash", "input": {"command": "pytest  x"}}], 1),
    chat("user", [{"type": "tool_result", "tool_use_id": "t1", "content": "1 failed", "is_error": True}], 2), chat("assistant", [{"type": "tool_use", "id": "t2", "name": "Read", "input": {"file_path": "a/b.py"}}], 3),
    chat("assistant", [{"type": "text", "text": "aside"}], 4, isSidechain=True), "{broken json that is long enough", "{}",
]


def test_chat_log_and_gzip(spark, tmp_path):
    write(tmp_path / "a.jsonl", [*CHAT, CHAT[1]])
    (tmp_path / "b.jsonl.gz").write_bytes(gzip.compress("\n".join(json.dumps(r | {"sessionId": "s2", "uuid": "g" + r["uuid"]}) for r in CHAT[:5]).encode()))
    ev = chat_events(files.read(spark, str(tmp_path), "unknown")).orderBy("session", "i").collect()
    for s in ("s1", "s2"):
        got = [(e.i, e.kind, e.tool, e.target, e.err, e.pending) for e in ev if e.session == s]
        assert got == [(0, "ask", None, None, None, None), (1, "say", None, None, None, None), (2, "tool", "Bash", "pytest x", True, False), (3, "tool", "Read", "a/b.py", False, True)]


def test_sessions_with_start_record(spark, tmp_path):
    write(tmp_path / "d.jsonl", [{"type": "session_start", "id": "d1", "cwd": "/w", "created_at": "2026-01-01T00:00:00Z"}, {"type": "message", "timestamp": "2026-01-01T00:00:01Z", "message": {"role": "user", "content": [{"type": "text", "text": "hello there"}]}}])
    r = files.read(spark, str(tmp_path), "droid").first()
    assert (r.sessionId, r.cwd) == ("d1", "/w") and chat_events(files.read(spark, str(tmp_path), "droid")).count() == 1


def test_rollouts_prefer_structured_items(spark, tmp_path):
    item = {"type": "CommandExecution", "command": ["bash", "-lc", "ls"], "aggregated_output": "x", "exit_code": 2, "status": "completed"}
    call = {"timestamp": "t", "type": "response_item", "payload": {"type": "function_call", "name": "shell", "call_id": "c", "arguments": json.dumps({"command": "ls"})}}
    ask = {"timestamp": "t", "type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "go"}]}}
    write(tmp_path / "a.jsonl", [ask, call, {"timestamp": "t", "type": "event_msg", "payload": {"type": "item_completed", "item": item}}])
    write(tmp_path / "b.jsonl", [ask, call, {"timestamp": "t", "type": "response_item", "payload": {"type": "function_call_output", "call_id": "c", "output": "Exit code: 1"}}])
    ev = rollout_events(files.read(spark, str(tmp_path), "codex")).orderBy("session", "i").collect()
    assert [(e.kind, e.tool, e.target, e.err) for e in ev] == [("ask", None, None, None), ("tool", "Bash", "bash -lc ls", True), ("ask", None, None, None), ("tool", "shell", "ls", True)]


def test_documents(spark, tmp_path):
    doc = {"sessionId": "g1", "messages": [{"type": "user", "timestamp": "2026-01-01T00:00:00Z", "content": "hi"}, {"type": "gemini", "content": "ok", "toolCalls": [{"name": "run", "status": "error", "args": {"command": "ls"}}], "tokens": {"input": 10, "output": 5, "thoughts": 2}}]}
    (tmp_path / "x.json").write_text(json.dumps(doc, indent=1))
    ev = files.read(spark, str(tmp_path), "gemini").orderBy("i").collect()
    assert [(e.kind, e.tool, e.target, e.err, e.output) for e in ev] == [("ask", None, None, None, None), ("say", None, None, None, 7), ("tool", "run", "ls", True, None)]


def test_replay(spark, tmp_path):
    write(tmp_path / "r.jsonl", [{"kind": 0, "v": {"a": [1, 2, 3], "b": {}}}, {"kind": 1, "k": ["b", "c"], "v": 5}, {"kind": 2, "k": ["a"], "v": [9], "i": 1}, "broken", {"kind": 1, "k": ["x", "y", "z"], "v": 1}, {"kind": 2, "k": ["l"], "v": [1]}])
    assert json.loads(files.read(spark, str(tmp_path), "copilot").first().document) == {"a": [1, 9], "b": {"c": 5}, "x": {"y": {"z": 1}}, "l": [1]}


def test_discovery(spark, tmp_path):
    (tmp_path / "live/subagents").mkdir(parents=True)
    (tmp_path / "old").mkdir()
    for p in ("live/a.jsonl", "live/a.json", "live/b.json", "live/subagents/c.jsonl", "old/a.jsonl.gz", "old/z.jsonl.gz"):
        (tmp_path / p).write_text("x")
    live_ = files.discover(spark, str(tmp_path / "live"))
    name = lambda df: sorted(r.file.rsplit("/", 1)[1] for r in df.collect())
    assert name(live_) == ["a.json", "a.jsonl", "b.json"] and name(files.prefer(live_)) == ["a.jsonl", "b.json"]
    assert name(files.archived_only(files.discover(spark, str(tmp_path / "old")), live_)) == ["z.jsonl.gz"]
    seen = live_.where(F.col("file").endswith("b.json")).withColumn("size", F.col("size") + 1).unionByName(live_.where(~F.col("file").endswith("b.json")))
    assert name(files.changed(live_, seen)) == ["b.json"]


def test_generator_is_stable(spark):
    a = chat_events(files.generate(spark)).select("session", "i", "kind", "tool", "err")
    b = chat_events(files.generate(spark).repartition(7)).select("session", "i", "kind", "tool", "err")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0 and a.select("session").distinct().count() == 48


def test_sqlite_stores(spark, tmp_path):
    db = tmp_path / "s.db"
    with sqlite3.connect(db) as c:
        c.executescript("CREATE TABLE session(id TEXT, directory TEXT, model TEXT, time_created INT, time_updated INT); CREATE TABLE message(id TEXT, session_id TEXT, time_created INT, data TEXT); CREATE TABLE part(id TEXT, message_id TEXT, time_created INT, data TEXT); CREATE TABLE blobs(id TEXT, data BLOB); CREATE TABLE cursorDiskKV(key TEXT, value TEXT)")
        c.executemany("INSERT INTO session VALUES (?,?,?,?,?)", [("s1", "/w", "{}", 1, 100), ("s0", "/w", "{}", 1, 5)])
        c.executemany("INSERT INTO message VALUES (?,?,?,?)", [("m1", "s1", 1, '{"role":"user"}'), ("m2", "s1", 2, '{"info":{"role":"ai"}}'), ("m0", "s0", 1, '{"role":"user"}')])
        c.executemany("INSERT INTO part VALUES (?,?,?,?)", [("p2", "m1", 2, '{"type":"text","text":" there"}'), ("p1", "m1", 1, '{"type":"text","text":"hi"}'), ("p3", "m2", 3, '{"type":"tool","tool":"bash","state":{"status":"error","input":{"command":"ls"},"error":"no"}}'), ("p4", "m2", 4, "{broken")])
        c.executemany("INSERT INTO blobs VALUES (?,?)", [("b1", b'{"role":"user","content":"x <user_query>ask me</user_query>"}'), ("b2", b"\x00\x01"), ("b3", b'{"role":"assistant","content":"sure"}'), ("b4", b'{"role":"user","content":"noise"}')])
        c.executemany("INSERT INTO cursorDiskKV VALUES (?,?)", [("composerData:c1", '{"fullConversationHeadersOnly":[{"bubbleId":"y"},{"bubbleId":"x"}]}'), ("bubbleId:c1:x", "X"), ("bubbleId:c1:y", "Y"), ("other", "")])
    session, message, part = sqlite.read_store(spark, str(db), since_ms=50)
    assert [r.id for r in session.collect()] == ["s1"] and message.count() == 2
    ev = store_events(message, part).orderBy("i").collect()
    assert [(e.kind, e.text, e.tool, e.err) for e in ev] == [("ask", "hi there", None, None), ("tool", None, "bash", True)]
    assert [(r.role, r.text) for r in sqlite.read_blobs(spark, str(db)).orderBy("row_id").collect()] == [("user", "ask me"), ("assistant", "sure")]
    assert [r.bubble for r in sqlite.read_key_values(spark, str(db)).orderBy("n").collect()] == ["Y", "X"]


def test_sinks(spark, tmp_path):
    path, log, ledger = (str(tmp_path / x) for x in ("t", "log", "ledger"))
    a = spark.createDataFrame([("x", 1), ("y", 2), ("x", 1)], "k string, v int")
    assert sinks.append_new(a, path, "k") == 2 and sinks.append_new(a, path, "k") == 0
    up = lambda rows, n: sinks.upsert_log(spark.createDataFrame(rows, "k string, source_ms long, lane string, v int"), n, log)
    up([("x", 10, "final", 1), ("y", 10, "provisional", 1)], 0)
    up([("x", 9, "provisional", 2), ("y", 10, "final", 3), ("z", 1, "provisional", 4)], 1)
    up([("x", 9, "provisional", 2), ("y", 10, "final", 3), ("z", 1, "provisional", 4)], 1)
    assert {(r.k, r.v) for r in sinks.merged(spark, log, ["k"]).collect()} == {("x", 1), ("y", 3), ("z", 4)}
    up([("x", 11, "provisional", 7)], 2)  # later activity opens it again
    assert {(r.k, r.v) for r in sinks.merged(spark, log, ["k"]).collect()} == {("x", 7), ("y", 3), ("z", 4)}
    out = tmp_path / "sent"
    out.mkdir()

    def send(rows):
        (out / f"{rows[0]['fingerprint']}").write_text(str(len(rows)))

    assert sinks.upload(a.distinct(), ledger, "k", send, batch=1) == 2 and sinks.upload(a.distinct(), ledger, "k", send) == 0 and len(list(out.iterdir())) == 2


def test_stream_equals_batch_in_any_chunking(spark, data, tmp_path):
    """Files that arrive in several triggers, late results among them, give what one batch gives."""
    claude = spark.read.parquet(f"{data}/claude.parquet")
    want = pieces.with_piece(chat_events(claude)).where("kind = 'tool'").groupBy("session", "piece").agg(F.count("*").alias("n_calls"), F.count_if("err").alias("n_errs"), F.count_if("pending").alias("pending"))
    folder = tmp_path / "in/claude.parquet"
    claude.repartitionByRange(5, "row_id").sortWithinPartitions("row_id").write.parquet(str(folder))
    parts = sorted(folder.glob("part-*"))
    for k, p in enumerate(parts):  # arrival in order of time
        import os

        os.utime(p, (1_700_000_000 + 10 * k,) * 2)
    got = live.run_pieces(live.stream_table(spark, str(tmp_path / "in"), "claude", files=1), f"chunks-{uuid.uuid4().hex}").where("n_calls > 0")
    assert rows(got.select("session", "piece", "n_calls", "n_errs", "pending").toPandas()) == rows(want.toPandas())


def test_live_state():
    import pandas as pd

    col = ["uuid", "row_id", "pos", "ms", "kind", "text", "call_id", "err"]
    feed = lambda lp, rows_: lp.feed(pd.DataFrame(rows_, columns=col))
    lp = live.LivePieces()
    feed(lp, [("a", 1, 0, 1, "ask", "do x", None, False), ("b", 2, 0, 2, "tool", None, "c1", False), ("b", 2, 0, 2, "tool", None, "c1", False), ("c", 3, 0, 3, "ask", "continue", None, False), ("d", 4, 0, 4, "ask", "do y", None, False)])
    assert lp.out("s", {1}).values.tolist() == [["s", 1, 1, 0, 1, 3, "provisional"]]  # a call is outstanding
    assert feed(lp, [("e", 5, 0, 9, "result", None, "c1", True)]) == {1}  # a late result changes the closed piece
    assert lp.out("s", {1}).values.tolist() == [["s", 1, 1, 1, 0, 9, "final"]]


def test_settle(spark):
    df = spark.createDataFrame([("a", 0, 1000, "provisional"), ("b", 1, 1000, "provisional"), ("c", 0, 2_000_000, "provisional")], "k string, pending int, source_ms long, lane string")
    assert [r.lane for r in live.settle(df, 2_000_000).orderBy("k").collect()] == ["final", "provisional", "provisional"]


def test_threads_do_not_depend_on_partitions(spark, data):
    a = work.threads(spark, data).toPandas()
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        b = work.threads(spark, data).toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    key = ["session", "thread"]
    assert a.sort_values(key).astype(str).values.tolist() == b.sort_values(key).astype(str).values.tolist()
    assert set(streams.QUERIES) == {"stream_pieces", "stream_windows"}
