"""Queries of problem 5: schemas that drift between files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.operators.drift import Target, changes, file_fields, ingest
from weftline.sources.tables import table

# The consistent table; for each client the declared path of a column, then its promoted later names.
LOG = Target(
    columns={
        "record_id": ("str", {"claude": ("uuid", "recordId"), "message": ("id",)}),
        "record_type": ("str", {"claude": ("type", "kind"), "codex": ("type", "record_type")}),
        "written_at": ("str", {"claude": ("timestamp", "ts"), "codex": ("timestamp", "time"), "message": ("time_created", "created_at")}),
        "session": ("str", {"claude": ("sessionId", "session_id"), "codex": ("thread_id", "session_id"), "message": ("session_id", "sessionID")}),
        "cwd": ("str", {"claude": ("cwd", "workdir"), "codex": ("payload.cwd", "payload.workdir"), "message": ("data.path", "data.directory")}),
        "role": ("str", {"claude": ("message.role",), "codex": ("payload.role",), "message": ("data.role", "data.speaker")}),
        "model": ("str", {"claude": ("message.model", "message.model.id"), "message": ("data.modelID", "data.model_id")}),
        "parent_id": ("str", {"message": ("data.parentID", "data.parent_id")}),
        "content": ("arr", {"claude": ("message.content",), "codex": ("payload.content",)}),
        "item_type": ("str", {"codex": ("payload.type", "payload.kind")}),
        "call_id": ("str", {"codex": ("payload.call_id", "payload.callId")}),
        "call_name": ("str", {"codex": ("payload.name",)}),
        "call_input": ("str", {"codex": ("payload.arguments", "payload.args", "payload.arguments.cmd")}),
        "call_output": ("str", {"codex": ("payload.output", "payload.result", "payload.output.text")}),
        "stop_reason": ("str", {"claude": ("message.stop_reason", "message.finish_reason"), "message": ("data.finish", "data.stop_reason")}),
        "input_tokens": ("num", {"claude": ("message.usage.input_tokens", "message.usage.prompt_tokens"), "message": ("data.tokens.input", "data.tokens.prompt")}),
        "output_tokens": ("num", {"claude": ("message.usage.output_tokens", "message.usage.completion_tokens"), "message": ("data.tokens.output",)}),
        "total_tokens": ("num", {"codex": ("payload.total_tokens", "payload.tokens_total")}),
        "duration_ms": ("num", {"claude": ("durationMs",), "codex": ("payload.wall_ms",)}),
        "is_sidechain": ("bool", {"claude": ("isSidechain",)}),
        "permission_mode": ("str", {"claude": ("permissionMode", "permission_mode")}),
        "branch": ("str", {"claude": ("gitBranch", "branch", "gitBranch.name"), "message": ("project",)}),
    },
    embedded={"message": "data"},
)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return changes(file_fields(ingest(table(spark, d, "raw_records"), LOG), LOG))


def p5_table(spark: SparkSession, d: str) -> DataFrame:
    """Every line in one consistent table, with the rescued rest and what was replayed from it."""
    return ingest(table(spark, d, "raw_records"), LOG)


QUERIES = {"p5_found": p5_found, "p5_table": p5_table}
