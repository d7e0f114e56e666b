"""Normalised events: one ordered stream of ask, say and tool events per session, whatever client wrote it.

Schema: client, session, i (position, from 0), kind (ask, say, tool), ts, row_id, text, who, tool, target, call_id,
pending, err, denied, rejected, err_text, out, verdict, named_pr, act. verdict (fail or pass, by a call's output), named_pr
and act are read off the whole result or message. Texts, errors, outputs and targets are kept whole; views cut what they
show. The position is the order of delivery, then of blocks in the record. A doubled record counts once; a record
without a uuid is its own. A call and its result are joined on the call's id; a call without a result is pending.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weftline.functions.rules import first_rule
from weftline.functions.text import one_line
from weftline.operators import steps
from weftline.operators.stage import running

# Keys of a call's input that name its target, in order of preference.
TARGET_KEYS = ("file_path", "command", "pattern", "url", "path", "issue", "todo", "query")
DENIED = r"(?i)permission to use [a-z0-9_]+ has been denied"
REJECTED = r"(?i)tool use was rejected"
CONTINUE = r"(?i)^ *(continue|go on|keep going|proceed|yes|ok|okay|ok ship it|do it|go ahead|try again|resume)[.!]? *$"

COLUMNS = ("client", "session", "i", "kind", "ts", "row_id", "text", "who", "tool", "target", "call_id", "pending", "err", "denied", "rejected", "err_text", "out", "verdict", "named_pr", "act")


def target_of(json: Column) -> Column:
    return one_line(F.coalesce(*[F.get_json_object(json, f"$.{k}") for k in TARGET_KEYS]))


def distinct_records(claude: DataFrame) -> DataFrame:
    """Main-chain records of a session, each once: the first delivery stands."""
    rows = claude.where(F.col("sessionId").isNotNull() & ~F.coalesce("isSidechain", F.lit(False)))  # no test of the whole message: it would be read for it
    keys = rows.groupBy(F.coalesce("uuid", F.concat(F.lit("row:"), F.col("row_id").cast("string")))).agg(F.min("row_id").alias("row_id"))
    return rows.join(keys.select("row_id"), "row_id", "left_semi")


def outcome_columns(df: DataFrame) -> DataFrame:
    """Adds pending, err, denied, rejected, err_text, out, verdict and named_pr to calls with result columns ``r_err`` and ``r_text``, and act to messages with ``full``."""
    err = F.coalesce("r_err", F.lit(False))
    rejected = err & F.coalesce(F.col("r_text").rlike(REJECTED), F.lit(False))
    denied = err & F.coalesce(F.col("r_text").rlike(DENIED), F.lit(False))
    tool = F.col("kind") == "tool"
    good = F.when(tool & ~err, F.col("r_text"))
    verdict = F.when(good.rlike(steps.FAILED), "fail").when(good.rlike(steps.PASSED), "pass")
    pr = F.regexp_extract(F.concat_ws(" ", "target", good), steps.PR, 1)
    act = first_rule([(name, {"full": p["text"]}) for name, p in steps.ACTS], "other")
    return df.select(
        "*", F.when(tool, ~F.coalesce("answered", F.lit(False))).alias("pending"), F.when(tool, err).alias("err"), F.when(tool, denied | rejected).alias("denied"),
        F.when(tool, rejected).alias("rejected"), F.when(tool & err, F.col("r_text")).alias("err_text"), F.when(tool & ~err, F.col("r_text")).alias("out"),
        verdict.alias("verdict"), F.when(tool, F.nullif(pr, F.lit(""))).alias("named_pr"), F.when(F.col("kind") == "ask", "ask").when(F.col("kind") == "say", act).alias("act"),
    )


def numbered(df: DataFrame, *more: str) -> DataFrame:
    """Positions 0, 1, ... per session by (row_id, pos); a session of any size is cut over many tasks."""
    n = running(df, "session", "row_id", ["row_id", "pos"], sums={"_n": F.lit(1).cast("bigint")})
    return n.withColumn("i", F.col("_n") - 1).select(*COLUMNS, *more)


def chat_events(claude: DataFrame, *more: str) -> DataFrame:
    """Events of a chat log (table ``claude`` or one of its schema); ``more`` may name pos, full (a message's whole text) and r_text (a call's whole result)."""
    return events_of(distinct_records(claude), *more)


def events_of(records: DataFrame, *more: str) -> DataFrame:
    """``chat_events`` of ``distinct_records``."""
    rec = records.select("row_id", F.col("sessionId").alias("session"), F.col("ingested_at").cast("timestamp").alias("ts"), "message.role", "message.content")
    block = rec.select("row_id", "session", "ts", "role", F.posexplode("content").alias("pos", "b"))
    filled = F.coalesce(F.trim("b.text") != "", F.lit(False))
    kind = F.when((F.col("b.type") == "text") & filled & (F.col("role") == "user"), "ask").when((F.col("b.type") == "text") & filled, "say").when(F.col("b.type") == "tool_use", "tool")
    ev = block.withColumn("kind", kind).where("kind is not null")
    res = block.where((F.col("b.type") == "tool_result") & F.col("b.tool_use_id").isNotNull()).groupBy(F.col("session"), F.col("b.tool_use_id").alias("call_id")).agg(
        F.min_by(F.struct(F.col("b.is_error").alias("e"), F.col("b.content").alias("c")), "row_id").alias("r"))
    res = res.select("session", "call_id", F.col("r.e").alias("r_err"), F.col("r.c").alias("r_text"), F.lit(True).alias("answered"))
    ev = ev.select(
        F.lit("claude").alias("client"), "session", "kind", "ts", "row_id", "pos", F.when(F.col("kind") != "tool", F.col("b.text")).alias("text"),
        F.when(F.col("kind") == "ask", "human").alias("who"), F.when(F.col("kind") == "tool", F.col("b.name")).alias("tool"), F.when(F.col("kind") == "tool", F.coalesce(target_of(F.col("b.input")), F.lit(""))).alias("target"),
        F.when(F.col("kind") == "tool", F.col("b.id")).alias("call_id"), F.when(F.col("kind") != "tool", F.col("b.text")).alias("full"),
    )
    return numbered(outcome_columns(ev.join(res, ["session", "call_id"], "left")), *more)


def reasoning(claude: DataFrame) -> DataFrame:
    """(session, row_id, pos, text) of the agent's reasoning, each record once."""
    return reasoning_of(distinct_records(claude))


def reasoning_of(records: DataFrame) -> DataFrame:
    """``reasoning`` of ``distinct_records``."""
    rec = records.select("row_id", F.col("sessionId").alias("session"), F.posexplode("message.content").alias("pos", "b"))
    return rec.where((F.col("b.type") == "thinking") & F.col("b.thinking").isNotNull()).select("session", "row_id", "pos", F.col("b.thinking").alias("text"))


def rollout_events(codex: DataFrame) -> DataFrame:
    """Events of rollout records. A file that holds structured items is read by them alone, otherwise by raw calls."""
    first = codex.groupBy("file_name", "line_no").agg(F.min("row_id").alias("row_id"))
    rec = codex.join(first.select("row_id"), "row_id", "left_semi")
    rec = rec.withColumn("structured", F.max(F.col("payload.type") == "item_completed").over(W.partitionBy("file_name")))
    p = rec.select(F.col("file_name").alias("session"), F.col("line_no").cast("bigint").alias("row_id"), F.lit(0).alias("pos"), F.coalesce("structured", F.lit(False)).alias("structured"), "payload", F.try_parse_json("payload.item").alias("item"))
    get = lambda k, t="string": F.try_variant_get(F.col("item"), f"$.{k}", t)
    words = F.array_join(F.transform(F.col("payload.content"), lambda c: c["text"]), "\n")
    kind_item = F.when(get("type") == "UserMessage", "ask").when(get("type") == "AgentMessage", "say").when(get("type").isin("CommandExecution", "McpToolCall", "FileChange", "WebFetch"), "tool")
    kind_raw = F.when((F.col("payload.type") == "message") & (F.col("payload.role") == "user"), "ask").when((F.col("payload.type") == "message") & (F.col("payload.role") == "assistant"), "say").when(F.col("payload.type").isin("function_call", "custom_tool_call"), "tool")
    is_item = F.col("payload.type") == "item_completed"
    # Messages come in one form only; where there are items, calls are read from them.
    kind = F.when(is_item, kind_item).when(F.col("structured") & (kind_raw == "tool"), F.lit(None)).otherwise(kind_raw)
    ev = p.withColumn("is_item", is_item).withColumn("kind", kind).where("kind is not null")
    raw_text = F.coalesce(F.get_json_object("payload.output", "$.output"), F.col("payload.output"))
    res = p.where(F.col("payload.type").isin("function_call_output", "custom_tool_call_output") & F.col("payload.call_id").isNotNull()).groupBy("session", F.col("payload.call_id").alias("call_id")).agg(
        F.min_by(raw_text, "row_id").alias("x_text"))
    ev = ev.select(
        F.lit("codex").alias("client"), "session", "kind", F.lit(None).cast("timestamp").alias("ts"), "row_id", "pos", F.when(F.col("kind") != "tool", F.coalesce(get("content"), words)).alias("text"),
        F.when(F.col("kind") == "ask", "human").alias("who"), F.when(F.col("kind") == "tool", F.coalesce(F.when(F.col("is_item"), F.coalesce(get("tool"), F.when(get("type") == "CommandExecution", "Bash").otherwise(get("type")))), F.col("payload.name"))).alias("tool"),
        F.when(F.col("kind") == "tool", F.coalesce(F.array_join(F.try_variant_get(F.col("item"), "$.command", "array<string>"), " "), F.get_json_object("payload.arguments", "$.command"), F.col("payload.arguments"), F.col("payload.input"), F.lit(""))).alias("target"),
        F.col("payload.call_id").alias("call_id"), "is_item", F.when(F.col("kind") != "tool", F.coalesce(get("content"), words)).alias("full"), get("exit_code", "int").alias("exit_code"), get("aggregated_output").alias("i_text"), get("status").alias("i_status"),
    )
    ev = ev.join(res, ["session", "call_id"], "left")
    failed = F.when(F.col("is_item"), F.coalesce(F.col("exit_code") != 0, F.col("i_status").isin("failed", "declined"))).otherwise(F.coalesce(F.col("x_text").rlike(r"(?i)exit code:? [1-9]"), F.lit(False)))
    ev = ev.withColumn("r_err", failed).withColumn("r_text", F.coalesce("i_text", "x_text")).withColumn("answered", F.col("is_item") | F.col("x_text").isNotNull())
    return numbered(outcome_columns(ev))


def store_events(messages: DataFrame, parts: DataFrame) -> DataFrame:
    """Events of the message store: parts of a message in order of time; a text cut into parts is one event."""
    m = messages.groupBy("id").agg(F.min_by(F.struct("session_id", "data", "row_id"), "row_id").alias("m")).select(F.col("id").alias("message_id"), F.col("m.session_id").alias("session"), F.col("m.row_id").alias("row_id"), F.try_parse_json("m.data").alias("v"))
    role = F.lower(F.trim(F.coalesce(*[F.try_variant_get(F.col("v"), p, "string") for p in ("$.role", "$.info.role", "$.author.role")])))
    p = parts.where(F.col("message_id").isNotNull()).select("message_id", "time_created", F.col("row_id").alias("part"), F.try_parse_json("data").alias("d"))
    get = lambda k, t="string": F.try_variant_get(F.col("d"), f"$.{k}", t)
    p = p.select("message_id", "time_created", "part", get("type").alias("type"), get("text").alias("text"), get("tool").alias("tool"), get("state.status").alias("status"), F.coalesce(get("state.output"), get("state.error")).alias("r_text"), F.coalesce(*[get(f"state.input.{k}") for k in TARGET_KEYS]).alias("target"))
    text = p.where("type = 'text'").groupBy("message_id").agg(F.min(F.struct("time_created", "part")).alias("o"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("time_created", "part", "text"))), lambda x: x["text"]), "").alias("text"))
    text = text.select("message_id", F.col("o.time_created").alias("time_created"), F.col("o.part").alias("part"), F.lit("text").alias("type"), "text", *[F.lit(None).cast("string").alias(c) for c in ("tool", "status", "r_text", "target")])
    both = text.unionByName(p.where("type = 'tool'")).join(m.withColumn("role", role), "message_id")
    kind = F.when(F.col("type") == "tool", "tool").when(F.trim("text") == "", F.lit(None)).when(F.col("role").isin("user", "human"), "ask").when(F.col("role").isin("assistant", "ai", "model"), "say")
    ev = both.withColumn("kind", kind).where("kind is not null").select(
        F.lit("message").alias("client"), "session", "kind", F.timestamp_millis("time_created").alias("ts"), F.col("time_created").alias("row_id"), F.col("part").alias("pos"), F.when(F.col("kind") != "tool", F.col("text")).alias("text"),
        F.when(F.col("kind") == "ask", "human").alias("who"), "tool", F.when(F.col("kind") == "tool", F.coalesce("target", F.lit(""))).alias("target"), F.when(F.col("kind") == "tool", F.col("part").cast("string")).alias("call_id"),
        F.when(F.col("kind") != "tool", F.col("text")).alias("full"), (F.col("status") == "error").alias("r_err"), "r_text", F.col("status").isin("completed", "error").alias("answered"),
    )
    return numbered(outcome_columns(ev))


#: The same stream of chat events as SQL text, to be put before a query on ``ev``.
EVENTS_SQL = f"""
rec AS (SELECT c.row_id, c.sessionId AS session, c.ingested_at AT TIME ZONE 'UTC' AS ts, c.message.role AS role, c.message.content AS content
        FROM claude c SEMI JOIN (SELECT min(row_id) AS row_id FROM claude WHERE sessionId IS NOT NULL AND NOT coalesce(isSidechain, false) GROUP BY coalesce(uuid, 'row:' || row_id)) k ON k.row_id = c.row_id),
block AS (SELECT row_id, session, ts, role, unnest(content) AS b, generate_subscripts(content, 1) - 1 AS pos FROM rec),
res AS (SELECT session, b.tool_use_id AS call_id, arg_min(struct_pack(e := b.is_error, c := b.content), row_id) AS r FROM block WHERE b.type = 'tool_result' AND b.tool_use_id IS NOT NULL GROUP BY ALL),
raw_ev AS (SELECT session, ts, row_id, pos, b, CASE WHEN b.type = 'text' AND trim(b.text) <> '' AND role = 'user' THEN 'ask' WHEN b.type = 'text' AND trim(b.text) <> '' THEN 'say' WHEN b.type = 'tool_use' THEN 'tool' END AS kind FROM block),
ev0 AS (SELECT e.session, e.ts, e.row_id, e.pos, e.kind,
        CASE WHEN kind <> 'tool' THEN b.text END AS text, CASE WHEN kind = 'tool' THEN b.name END AS tool,
        CASE WHEN kind = 'tool' THEN coalesce(trim(regexp_replace(coalesce({', '.join(f"json_extract_string(b.input, '$.{k}')" for k in TARGET_KEYS)}), '\\s+', ' ', 'g')), '') END AS target,
        CASE WHEN kind = 'tool' THEN b.id END AS call_id, res.r.e AS r_err, res.r.c AS r_text, res.call_id IS NOT NULL AS answered
        FROM raw_ev e LEFT JOIN res ON res.session = e.session AND e.kind = 'tool' AND res.call_id = e.b.id WHERE kind IS NOT NULL),
ev AS (SELECT 'claude' AS client, session, row_number() OVER (PARTITION BY session ORDER BY row_id, pos) - 1 AS i, kind, ts, row_id, text, tool, target, call_id,
       CASE WHEN kind = 'tool' THEN NOT answered END AS pending, CASE WHEN kind = 'tool' THEN coalesce(r_err, false) END AS err,
       CASE WHEN kind = 'tool' THEN coalesce(r_err, false) AND (coalesce(regexp_matches(r_text, '{DENIED}'), false) OR coalesce(regexp_matches(r_text, '{REJECTED}'), false)) END AS denied,
       CASE WHEN kind = 'tool' THEN coalesce(r_err, false) AND coalesce(regexp_matches(r_text, '{REJECTED}'), false) END AS rejected,
       CASE WHEN kind = 'tool' AND coalesce(r_err, false) THEN r_text END AS err_text, CASE WHEN kind = 'tool' AND NOT coalesce(r_err, false) THEN r_text END AS out FROM ev0)
"""
