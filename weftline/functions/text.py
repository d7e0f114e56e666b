"""Text expressions: first sentence, tokens, error signatures, clipping, secrets. All are native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that say nothing about the subject of a text.
STOPWORDS = tuple("a an and are as at be but by can for from has have how i if in into is it its me my no not of on or our please so that the then there this to up us was we what when where which who why will with you your".split())


def one_line(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def first_sentence(c: Column, n: int = 72) -> Column:
    """The first sentence without marks; cut to ``n`` characters, the last one then being an ellipsis."""
    flat = one_line(F.regexp_replace(F.regexp_replace(c, r"</?[A-Za-z][^>]*>", " "), r"[*_`#>]+", ""))
    cut = F.regexp_extract(flat, r"^(.*?[.!?])(?: |$)", 1)
    s = F.when(cut == "", flat).otherwise(cut)
    return F.when(F.length(s) > n, F.concat(F.substring(s, 1, n - 1), F.lit("…"))).otherwise(s)


def tokens(c: Column) -> Column:
    """Words of a text, lower case: longer than two characters, no stop words, not digits alone."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(c), r"https?://[^ ]+", " "), r"[^a-z0-9#._/-]+", " ")
    words = F.transform(F.split(F.trim(plain), " "), lambda w: F.regexp_replace(w, r"^[._/-]+|[._/-]+$", ""))
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*STOPWORDS) & ~w.rlike("^[0-9]+$"))


def error_line(c: Column) -> Column:
    """The first line of an error text that says something."""
    lines = F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: (F.length(x) > 8) & ~F.lower(x).rlike(r"^(exit code|process exited|wall time|output:)"))
    return F.try_element_at(lines, F.lit(1))


def error_signature(tool: Column, c: Column) -> Column:
    """What makes two errors the same: paths, ids, numbers and quoted parts are masked; null where too little is left."""
    s = F.lower(error_line(c))
    s = F.regexp_replace(s, r"[a-z0-9_.@~-]*(?:/[a-z0-9_.@~-]+)+", "<path>")
    s = F.regexp_replace(s, r"[0-9a-f]{7,}", "<id>")
    s = F.regexp_replace(s, r"[0-9]+(?:\.[0-9]+)?", "n")
    s = F.regexp_replace(s, r"\"[^\"]*\"", '"…"')
    s = F.regexp_replace(s, r"'[^']*'", '"…"')
    s = F.substring(one_line(F.regexp_replace(s, r"^(?:error|fatal)[: ]+", "")), 1, 90)
    return F.when(F.length(s) > 6, F.concat(tool, F.lit(": "), s))


def head_tail(values: Column, head: int, tail: int) -> Column:
    """An array cut to its first ``head`` and last ``tail`` elements; shorter ones stay whole."""
    return F.when(F.size(values) > head + tail, F.concat(F.slice(values, 1, head), F.slice(values, -tail, tail))).otherwise(values)


# Secrets, as (name, word that must occur, pattern).
SECRETS = (
    ("github_token", "gh", r"gh[pousr]_[A-Za-z0-9]{20,}"),
    ("aws_key", "AKIA", r"AKIA[0-9A-Z]{16}"),
    ("private_key", "PRIVATE KEY", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    ("bearer", "earer", r"[Bb]earer [A-Za-z0-9._~+/-]{16,}=*"),
    ("assigned", "=", r"(?:api_key|apikey|secret|token|password|passwd)=[^ \n\"']{6,}"),
    ("hex_digest", "sha", r"[0-9a-f]{40}"),
)


def redact(c: Column) -> Column:
    """A text with ``[redacted:<rule>]`` in place of secrets; the cheap word test goes before each pattern."""
    for name, word, pattern in SECRETS:
        c = F.when(F.contains(c, F.lit(word)), F.regexp_replace(c, pattern, f"[redacted:{name}]")).otherwise(c)
    return c


def entropy(c: Column) -> Column:
    """Bits per character of a text, over its distinct characters; 0 for empty, null for null."""
    chars = F.split(c, "")
    n = F.length(c)
    bits = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, x: acc + (lambda p: -p * F.log2(p))(F.size(F.filter(chars, lambda y: y == x)) / n))
    return F.when(n > 0, bits).when(n == 0, F.lit(0.0))
