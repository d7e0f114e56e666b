"""Subject areas of documents (problem 10): labels propagated over a verified graph of shared wording.

Documents are linked where they share statements, and statements where they share a phrase of one to ``WORDS`` words.
The graph is kept in its factors, document - statement - phrase: boilerplate that a third of all documents share would
make quadratically many document pairs, in its factors it is one node. Labels start at the labelled documents and go
down to the phrases and back up, by joins, round after round, until the documents' beliefs move by less than
``SETTLED`` on average:

    document -> statement -> phrase    evidence of a phrase: the subjects of all documents that use it
    phrase -> statement -> document    subjects of a statement: those of the phrases that passed verification

A phrase is verified if its evidence stands for one subject well beyond chance; where a longer verified phrase covers
it, its occurrence does not count, so a word that is only part of a term (or a figure of speech) gets no subject from
the term. Labels that the text bears out are trusted: these seeds are clamped, in every round their subject keeps the
largest belief that their document has. A label that nothing in the text supports is not trusted. Documents keep as
many subjects as they deal with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weftline.operators.stage import salted_left_join, written

WORDS = 4
#: The propagation ends when beliefs move by less than this on average; so many rounds without rest raise an error.
SETTLED, ROUNDS = 0.02, 12
#: Most subject areas, each of which is one column of evidence; more raise an error.
MOST_AREAS = 200


def statements(documents: DataFrame) -> DataFrame:
    """(doc_id, no, sid, opens, whole, seg, part) of each statement, a row per part of it between numbers and punctuation.

    Line marks of speakers, lists and headings are cut off and remarks in brackets left out. Parts are in lower case;
    no phrase crosses numbers, ids, paths and punctuation. ``sid`` and ``seg`` are 64-bit hashes of the statement and
    of the part, ``no`` numbers the statements of a document, ``opens`` tells whether one opens its line, ``whole``
    whether it ends as a sentence. Null, empty and blank texts have no statements.
    """
    text = F.regexp_replace("text", r"(?m)^[ \t]*(?:#+ .*|(?:user|assistant|system|human|ai): |[-*] )", "")
    text = F.regexp_replace(text, r"\([^()\n]*\)", " ")
    line = documents.where(F.col("text").isNotNull()).select("doc_id", F.posexplode(F.split(text, r"[\r\n]+")).alias("row", "line"))
    one = line.select("doc_id", "row", F.posexplode(F.split("line", r"(?<=[.?!])\s+")).alias("pos", "s")).where(F.col("s").rlike(r"\p{L}"))
    s = F.regexp_replace(F.lower("s"), r"\S*[\\/0-9]\S*", "|")
    s = F.regexp_replace(s, r"\s+", " ")
    s = F.trim(F.regexp_replace(s, r" ?[^\p{L}\p{M}'’\- ]+ ?", "|"))
    out = one.select("doc_id", (F.col("row") * F.lit(1_000_000) + F.col("pos")).alias("no"), (F.col("pos") == 0).alias("opens"), F.col("s").rlike(r"[.?!]\s*$").alias("whole"), s.alias("s"))
    out = out.withColumn("sid", F.xxhash64("s")).select("*", F.explode(F.array_distinct(F.split("s", r"\|"))).alias("part")).drop("s")
    return out.where(F.col("part").rlike(r"\p{L}")).withColumn("seg", F.xxhash64("part"))


def phrases(distinct: DataFrame) -> DataFrame:
    """(seg, marks): the phrases of each distinct part (seg, part) as an array of (start, stop, phrase), phrase a 64-bit hash of its words."""
    distinct = distinct.select("seg", F.split("part", " ").alias("words"))
    n = F.size("words")

    def of_length(k: int) -> Column:
        starts = F.when(n >= k, F.sequence(F.lit(1), n - (k - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct(i.alias("start"), (i + (k - 1)).alias("stop"), F.xxhash64(F.array_join(F.slice("words", i, F.lit(k)), " ")).alias("phrase")))

    return distinct.select("seg", F.concat(*[of_length(k) for k in range(1, WORDS + 1)]).alias("marks"))


def _spans(marks: DataFrame, *fields: str) -> DataFrame:
    """(seg, all): the marks of a part as one array: at most WORDS marks per word of one sentence."""
    return marks.groupBy("seg").agg(F.collect_list(F.struct("start", "stop", *fields)).alias("all"))


def _covered(x: Column) -> Column:
    """True where a longer mark in the array ``all`` covers the phrase ``x`` (start, stop)."""
    longer = lambda y: (y["start"] <= x["start"]) & (y["stop"] >= x["stop"]) & ((y["stop"] - y["start"]) > (x["stop"] - x["start"]))
    return F.coalesce(F.exists("all", longer), F.lit(False))


def standing(marks: DataFrame) -> DataFrame:
    """(seg, subject) of ``marks`` (seg, start, stop, subject, score): those that no longer mark covers and no stronger mark of another subject overlaps."""

    def beaten(x: Column) -> Column:
        stronger = lambda y: (y["start"] <= x["stop"]) & (y["stop"] >= x["start"]) & (y["subject"] != x["subject"]) & (y["score"] > x["score"])
        return F.exists("all", stronger)

    top = F.filter("all", lambda x: ~_covered(x) & ~beaten(x))
    return _spans(marks, "subject", "score").select("seg", F.explode(F.array_distinct(F.transform(top, lambda x: x["subject"]))).alias("subject"))


def uncovered(occurrences: DataFrame, marks: DataFrame) -> DataFrame:
    """``occurrences`` (seg, start, stop, phrase) that no longer mark of the part covers."""
    return occurrences.join(_spans(marks), "seg", "left").where(~_covered(F.struct("start", "stop"))).drop("all")


def _cols(n: int) -> list[str]:
    """One column of evidence per subject area; the areas are a small fixed table."""
    return [f"s{k}" for k in range(n)]


def evidence_of(occurrences: DataFrame, down: DataFrame) -> DataFrame:
    """(phrase, s0, ...): what the documents say of each phrase of ``occurrences`` (seg, phrase); ``down`` (seg, s0, ...) is what they say of each part."""
    cols = [c for c in down.columns if c != "seg"]
    return occurrences.select("seg", "phrase").distinct().join(down, "seg").groupBy("phrase").agg(*[F.sum(c).alias(c) for c in cols])


def score(n: Column, total: Column, base: float, z: float) -> Column:
    """How far a subject's share of a phrase is beyond chance: the lower end of its Wilson interval, less the subject's share
    ``base`` of all evidence, divided by what there is beyond that. Wording that says nothing has about 0."""
    share = n / total
    low = (share + z * z / (2 * total) - z * F.sqrt(F.greatest(F.lit(0.0), share * (1 - share) / total + z * z / (4 * total * total)))) / (1 + z * z / total)
    return (low - base) / (1 - base) if base < 1 else low - base


def standing_for(evidence: DataFrame, base: list[float], least: float = 0.3, support: float = 2.0) -> DataFrame:
    """(phrase, subject, score) of phrases that stand for one subject, given by its number: the largest score is at least ``least``, on ``support`` or more."""
    cols = _cols(len(base))
    total = sum((F.col(c) for c in cols[1:]), F.col(cols[0]))
    best = F.array_max(F.array(*[F.struct(score(F.col(c), F.col("all"), p, 1.5).alias("score"), F.lit(k).alias("subject")) for k, (c, p) in enumerate(zip(cols, base))]))
    return evidence.withColumn("all", total).where(F.col("all") >= support).select("phrase", best.alias("b")).where(F.col("b.score") >= least).select("phrase", "b.subject", "b.score")


def still_standing(mine: DataFrame, free: DataFrame, base: list[float], least: float = 0.3, enough: float = 3.0) -> DataFrame:
    """The occurrences ``mine`` (seg, start, stop, phrase, subject, score) of phrases that pass the test of ``free``.

    ``free`` is the evidence of the occurrences that no longer verified phrase covers: where there is ``enough`` of it,
    it has to speak for the same subject with at least half of ``least``, so a word that only belongs to a term of two
    words, or to a figure of speech, does not pass.
    """
    cols = _cols(len(base))
    total = sum((F.col(c) for c in cols[1:]), F.col(cols[0]))
    heard = free.withColumn("all", total).where(F.col("all") >= enough).select("phrase", F.array(*[score(F.col(c), F.col("all"), p, 0.5) for c, p in zip(cols, base)]).alias("free"))
    return mine.join(heard, "phrase", "left").where(F.col("free").isNull() | (F.element_at("free", F.col("subject") + 1) >= least / 2)).select(*mine.columns)


def seeds_of(labels: DataFrame, names: list[str], documents: DataFrame) -> DataFrame:
    """(doc_id, s0, ...): the labels that name a subject area, as shares of the document's labels."""
    ok = labels.where(F.col("doc_id").isNotNull()).select("doc_id", F.lower(F.trim("subject")).alias("subject")).where(F.col("subject").isin(names))
    return _shares(ok.groupBy("doc_id").agg(*[F.count_if(F.col("subject") == x).cast("double").alias(c) for x, c in zip(names, _cols(len(names)))]), len(names))


def _shares(counts: DataFrame, n: int) -> DataFrame:
    total = sum((F.col(c) for c in _cols(n)[1:]), F.col("s0"))
    return counts.withColumn("_all", total).where("_all > 0").select("doc_id", *[(F.col(c) / F.col("_all")).alias(c) for c in _cols(n)])


class Graph:
    """The factors of the graph, each written once: statements with their parts, edges document - part, phrases of parts."""

    def __init__(self, documents: DataFrame):
        rows = written(statements(documents))
        self.rows = rows.drop("part")
        self.edges = written(rows.groupBy("doc_id", "seg").agg(F.count("*").alias("times")))
        self.parts = written(phrases(rows.groupBy("seg").agg(F.first("part").alias("part"))))


def verified_parts(graph: Graph, belief: DataFrame, n: int) -> DataFrame:
    """(seg, subject): the subjects, by number, of every part of a statement, as the documents' ``belief`` (doc_id, s0, ...) has it."""
    cols = _cols(n)
    # A document of several subjects says less about each of its statements: its shares count squared.
    down = written(graph.edges.join(belief, "doc_id").groupBy("seg").agg(*[F.sum(F.col(c) * F.col(c) * F.col("times")).alias(c) for c in cols]))
    sums = [x or 0.0 for x in down.agg(*[F.sum(c) for c in cols]).first()]
    base = [x / (sum(sums) or 1.0) for x in sums]
    said = graph.parts.join(down, "seg").select(F.explode(F.array_distinct(F.transform("marks", lambda x: x["phrase"]))).alias("phrase"), *cols)
    known = written(standing_for(said.groupBy("phrase").agg(*[F.sum(c).alias(c) for c in cols]), base))
    # Only phrases that stand for a subject go on; all others are let go here.
    occ = written(graph.parts.select("seg", F.explode("marks").alias("m")).select("seg", "m.*").join(known, "phrase").select("seg", "start", "stop", "phrase", "subject", "score"))
    marks = None
    for k in range(WORDS, 0, -1):  # from long phrases to short: a short one is judged by what no accepted longer one covers
        mine = occ.where(F.col("stop") - F.col("start") == k - 1)
        new = mine if marks is None else still_standing(mine, evidence_of(uncovered(mine, marks), down), base)
        marks = new if marks is None else written(marks.unionByName(new))
    return written(standing(marks))


def propagate(graph: Graph, seeds: DataFrame, n: int, rounds: int = ROUNDS) -> DataFrame:
    """(seg, subject) after as many rounds down and up the graph as it takes the beliefs to settle."""
    cols = _cols(n)
    belief = seeds = written(seeds)
    for _ in range(rounds):
        topical = verified_parts(graph, belief, n)
        told = salted_left_join(graph.edges, topical.groupBy("seg").agg(F.collect_list("subject").alias("subjects")), ["seg"]).where("subjects is not null")  # at most n subjects
        said = told.select("doc_id", "times", F.explode("subjects").alias("subject")).groupBy("doc_id").agg(*[F.sum(F.when(F.col("subject") == k, F.col("times")).otherwise(0)).cast("double").alias(c) for k, c in enumerate(cols)])
        both = _shares(said, n).select("doc_id", F.array(*cols).alias("h")).join(seeds.select("doc_id", F.array(*cols).alias("l")), "doc_id", "left")
        label = lambda k: F.coalesce(F.col("l")[k], F.lit(0.0)) > 0
        trusted = F.coalesce(F.exists(F.arrays_zip("h", "l"), lambda x: (x["h"] > 0) & (x["l"] > 0)), F.lit(False))
        clamped = both.select("doc_id", *[F.when(trusted & label(k), F.array_max("h")).otherwise(F.col("h")[k]).alias(c) for k, c in enumerate(cols)])
        new = written(_shares(clamped, n))
        was = belief.select("doc_id", F.array(*cols).alias("was"))
        moved = new.select("doc_id", F.array(*cols).alias("now")).join(was, "doc_id", "full")
        zero = F.array_repeat(F.lit(0.0), n)
        change = F.aggregate(F.zip_with(F.coalesce("now", zero), F.coalesce("was", zero), lambda x, y: F.abs(x - y)), F.lit(0.0), lambda x, y: x + y) / 2
        rest = moved.agg(F.avg(change)).first()[0]
        if rest is None or rest < SETTLED:
            return topical
        belief = new
    raise RuntimeError(f"beliefs did not settle within {rounds} rounds")


def plain_statements(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """(sid) of the statements that count as such: those that end as a sentence and are no addition.

    An addition (nearly) never opens a line and follows so many different statements that this is no chance: at the
    share of statements that open a line in the corpus, it would happen to less than one in 1,000. All is counted over
    distinct texts, and what a statement follows over distinct statements, so copies weigh nothing.
    """
    once = documents.where(F.col("text").isNotNull()).groupBy(F.xxhash64("text")).agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct()
    each = rows.select("doc_id", "no", "sid", "opens", "whole").distinct().join(once, "doc_id", "left_semi")
    line = W.partitionBy("doc_id", F.floor(F.col("no") / 1_000_000)).orderBy("no", "sid")
    each = each.withColumn("before", F.when(~F.col("opens"), F.lag("sid").over(line)))
    usual = written(each.groupBy("sid").agg(F.count("*").alias("n"), F.count_if("opens").alias("opening"), F.count_distinct("before").alias("follows"), F.max("whole").alias("whole")))
    n, opening = usual.agg(F.sum("n"), F.sum("opening")).first()
    rate = (opening or 0) / (n or 1)
    addition = (F.col("opening") < 0.02 * F.col("n")) & (F.pow(F.lit(1 - rate), F.col("follows")) < 0.001)
    return usual.where(F.col("whole") & ~addition).select("sid")


def subjects_of(documents: DataFrame, labels: DataFrame, areas: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, subject): subjects that two or more statements of the document deal with, or its only statement.

    An addition (see ``plain_statements``) and a line that is no sentence is no statement of its own. Documents without
    a subject have no row; doubled documents have their rows each; empty tables give none. ``areas`` is a small fixed
    table; labels that name no area are left out.
    """
    names = [r[0] for r in areas.select(F.lower(F.trim("subject")).alias("s")).where("s is not null").distinct().orderBy("s").take(MOST_AREAS + 1)]
    if len(names) > MOST_AREAS:
        raise ValueError(f"more than {MOST_AREAS} subject areas")
    if not names:
        return documents.select("doc_id", F.lit(None).cast("string").alias("subject")).where("false")
    graph = Graph(documents)
    topical = propagate(graph, seeds_of(labels, names, documents), len(names), rounds)
    of_part = topical.groupBy("seg").agg(F.collect_list("subject").alias("subjects"))
    told = salted_left_join(graph.rows.select("doc_id", "no", "sid", "seg"), of_part, ["seg"]).where("subjects is not null")
    about = written(told.select("doc_id", "no", "sid", F.explode("subjects").alias("subject")).distinct())
    said = about.groupBy("doc_id", "subject").agg(F.count("*").alias("c"))
    each = graph.rows.select("doc_id", "no", "sid").distinct()
    plain = plain_statements(graph.rows, documents)
    counted = about.select("sid").unionByName(plain).distinct().withColumn("counts", F.lit(1))
    total = salted_left_join(each, counted, ["sid"]).groupBy("doc_id").agg(F.sum("counts").alias("all"))
    word = F.element_at(F.array(*map(F.lit, names)), F.col("subject") + 1)
    return said.join(total, "doc_id").where((F.col("c") >= 2) | (F.col("all") == 1)).select("doc_id", word.alias("subject"))


def composition(documents: DataFrame, found: DataFrame) -> DataFrame:
    """(subject, n_docs, n_chars, doc_share) of the corpus; documents with several subjects count for each; '(none)' for the rest."""
    base = documents.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("size"))
    n = documents.count()
    each = base.join(found, "doc_id", "left").groupBy(F.coalesce("subject", F.lit("(none)")).alias("subject")).agg(F.countDistinct("doc_id").alias("n_docs"), F.sum("size").alias("n_chars"))
    return each.select("subject", "n_docs", "n_chars", (F.col("n_docs") / F.lit(max(1, n))).alias("doc_share"))
