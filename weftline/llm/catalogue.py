"""Queries of the problems on records of language models, by name, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import consensus, conversations, mixture, pii, runs, splits, subjects, tokens
from weftline.operators.stage import written
from weftline.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.found_in_blocks(pii.text_blocks(table(spark, d, "claude")))


def p1_masked(spark: SparkSession, d: str) -> DataFrame:
    """Every text block with typed placeholders in place of personal data."""
    return pii.mask_texts(pii.text_blocks(table(spark, d, "claude")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return consensus.consensus(table(spark, d, "gold_labels")).select("item_key", "label_field", "label_value")


def p2_reliability(spark: SparkSession, d: str) -> DataFrame:
    return consensus.reliability(table(spark, d, "gold_labels"))


def p2_agreement(spark: SparkSession, d: str) -> DataFrame:
    return consensus.agreement(table(spark, d, "gold_labels"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.linked_pairs(splits.judgment_nodes(table(spark, d, "claude_judgment")))


def p3_splits(spark: SparkSession, d: str) -> DataFrame:
    """The split of every record of claude_judgment."""
    nodes = splits.judgment_nodes(table(spark, d, "claude_judgment"))
    return splits.assign_splits(nodes, table(spark, d, "split_targets")).select("row_id", "session", "label", "split_name")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    found = runs.collapse_runs(runs.call_events(table(spark, d, "claude"), table(spark, d, "machines")))
    return found.select(F.col("entity").alias("session_id"), F.col("first_id").alias("first_call_id"), F.col("last_id").alias("last_call_id"), F.col("n").alias("n_calls"))


def p4_runs(spark: SparkSession, d: str) -> DataFrame:
    """Every run, single calls too, with its count and duration."""
    found = runs.collapse_runs(runs.call_events(table(spark, d, "claude"), table(spark, d, "machines")), least=1)
    return found.select(F.col("entity").alias("session_id"), F.col("first_id").alias("first_call_id"), F.col("n").alias("n_calls"), (F.col("last_ms") - F.col("first_ms")).alias("duration_ms"))


def p4_similar(spark: SparkSession, d: str, tolerance: float = 0.34, max_gap_ms: int = 3_600_000) -> DataFrame:
    """Runs of calls that are nearly the same: a third of the words may differ, and no pause is longer than an hour."""
    found = runs.similar_runs(runs.call_events(table(spark, d, "claude"), table(spark, d, "machines"), words=True), tolerance, max_gap_ms)
    return found.select(F.col("entity").alias("session_id"), F.col("first_id").alias("first_call_id"), F.col("n").alias("n_calls"), (F.col("last_ms") - F.col("first_ms")).alias("duration_ms"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    machines = table(spark, d, "machines")
    judgment = conversations.judgment_records(table(spark, d, "claude_judgment"), machines)
    store = conversations.store_records(table(spark, d, "oc_message"), table(spark, d, "oc_part"), table(spark, d, "oc_session"), machines)
    key = lambda src, df: df.select(F.concat(F.lit(src), F.lit("\x1f"), "session").alias("session"), *[F.concat(F.lit(src), F.lit("\x1f"), c).alias(c) for c in ("record",)],
        F.when(F.coalesce(F.trim("parent"), F.lit("")) != "", F.concat(F.lit(src), F.lit("\x1f"), "parent")).alias("parent"), "ms", "tie", "role", "spoken")
    turns = conversations.assemble(key("judgment", judgment).unionByName(key("opencode", store)))
    part = lambda c, i: F.element_at(F.split(F.col(c), "\x1f"), i)
    return turns.select(part("session", 1).alias("src"), part("session", 2).alias("session_id"), "turn_no", part("record", 2).alias("message_key"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_documents(table(spark, d, "documents"))


def p8_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, n_ids, same): whether the decoded ids give the text back; null and empty texts come back empty."""
    return tokens.round_trip(table(spark, d, "documents").select("doc_id", "text"))


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    return written(tokens.count_tokens(table(spark, d, "documents"), "source"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The documents drawn, with how often each is used."""
    return mixture.draw(_sizes(spark, d), table(spark, d, "mix_targets")).select("doc_id", "source", "n_tokens", "repeats")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of every source."""
    sizes, targets = _sizes(spark, d), table(spark, d, "mix_targets")
    return mixture.shares(written(mixture.draw(sizes, targets)), sizes, targets)


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    return subjects.subjects_of(table(spark, d, "documents"), table(spark, d, "subject_labels"), table(spark, d, "subject_areas"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _subjects(spark, d)


def p10_composition(spark: SparkSession, d: str) -> DataFrame:
    return subjects.composition(table(spark, d, "documents"), _subjects(spark, d))


QUERIES = {f.__name__: f for f in (p1_found, p1_masked, p2_found, p2_reliability, p2_agreement, p3_found, p3_splits, p4_found, p4_runs, p4_similar, p7_found, p8_ids, p8_round_trip, p9_mix, p9_shares, p10_found, p10_composition)}

_CODE = {f: "CASE " + " ".join(f"WHEN w_{f} = '{w}' THEN {i}" for i, w in enumerate(words)) + "".join(f" WHEN w_{f} = '{a}' THEN {words.index(b)}" for a, b in consensus.SYNONYMS[f].items()) + " END" for f, words in consensus.CODEBOOK.items()}
_WORD = ", ".join(f"regexp_replace(lower(trim({f})), '[\\s-]+', '_', 'g') AS w_{f}" for f in consensus.CODEBOOK)
_VOTE = ", ".join(f"arg_min({c}, struct_pack(r := coalesce(is_repeat, false), t := coalesce(labeled_at, TIMESTAMPTZ '9999-12-31'), l := label_id)) FILTER ({c} IS NOT NULL) AS {f}" for f, c in _CODE.items())
_MISSING = "|".join(splits.MISSING)
SQL: dict[str, str] = {
    "p2_agreement": f"""WITH g AS (SELECT *, {_WORD} FROM gold_labels WHERE item_key IS NOT NULL AND labeler IS NOT NULL), one AS (SELECT item_key, labeler, {_VOTE} FROM g GROUP BY item_key, labeler),
        v AS ({" UNION ALL ".join(f"SELECT item_key AS item, '{f}' AS field, {f} AS v FROM one WHERE {f} IS NOT NULL" for f in consensus.CODEBOOK)}),
        cell AS (SELECT item, field, v, count(*) AS n FROM v GROUP BY ALL), it AS (SELECT item, field, sum(n) AS m, sum(n * (n - 1)) AS pairs FROM cell GROUP BY ALL HAVING sum(n) > 1),
        seen AS (SELECT field, count(*) AS n_items, sum(m) AS votes, sum(pairs / (m - 1)) AS agree FROM it GROUP BY field), mg AS (SELECT field, sum(c * (c - 1)) AS cc FROM (SELECT field, v, sum(n) AS c FROM cell SEMI JOIN it USING (item, field) GROUP BY field, v) GROUP BY field)
        SELECT field AS label_field, n_items, agree / votes AS observed, cc / (votes * (votes - 1)) AS expected, (agree / votes - cc / (votes * (votes - 1))) / (1 - cc / (votes * (votes - 1))) AS alpha FROM seen JOIN mg USING (field)""",
    "p3_found": f"""WITH RECURSIVE h AS (SELECT uuid, parentUuid AS parent, replace(regexp_extract(lower(sessionId), '([0-9a-f]{{8}}-?[0-9a-f]{{4}}-?[0-9a-f]{{4}}-?[0-9a-f]{{4}}-?[0-9a-f]{{12}})', 1), '-', '') AS h, trim(message.id) AS m, regexp_replace(regexp_replace(lower(trim(message.id)), '[\\s\\p{{P}}\\p{{S}}]', '', 'g'), '^(msg(01)?|message|id)', '') AS bare FROM claude_judgment),
        r AS MATERIALIZED (SELECT uuid, parent, CASE WHEN NOT (bare = '' OR regexp_matches(bare, '^({_MISSING})$') OR (length(bare) > 0 AND replace(bare, bare[1], '') = '')) THEN m END AS m, h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] AS s FROM h WHERE length(h) = 32),
        e AS MATERIALIZED (SELECT DISTINCT a.s AS a, b.s AS b FROM r a JOIN r b ON a.m = b.m AND a.s <> b.s UNION SELECT DISTINCT a.s, b.s FROM r a JOIN r b ON (a.parent = b.uuid OR b.parent = a.uuid) AND a.s <> b.s),
        reach AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b) SELECT DISTINCT a AS session_a, b AS session_b FROM reach WHERE a < b""",
}
