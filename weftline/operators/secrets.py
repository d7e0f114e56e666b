"""Secrets in texts: words that must be near, a pattern, an entropy that the secret must have, an allow list, and one
non-overlapping choice, the leftmost and of those the longest. Applied to every string of a row, nested ones too.

A native test for the words goes first, so only texts that hold one reach Python.
"""

from __future__ import annotations

import json
import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Name, words of which one must occur, pattern (group 1, where there is one, is the secret), least entropy in bits per character.
RULES: tuple[tuple[str, tuple[str, ...], str, float], ...] = (
    ("authorization", ("authorization", "x-api-key"), r"""(?i)\b(?:authorization|x-api-key)\s*[:=]\s*["']?(?:bearer|basic|token)?\s*([A-Za-z0-9._~+/=-]{24,})""", 0.0),
    ("github_token", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), r"\bgh[pousr]_[A-Za-z0-9]{36,}", 3.0),
    ("github_fine_grained", ("github_pat_",), r"\bgithub_pat_[A-Za-z0-9_]{60,}", 3.0),
    ("gitlab_token", ("glpat-",), r"\bglpat-[A-Za-z0-9_-]{20}", 3.0),
    ("aws_key", ("akia", "asia", "abia"), r"\b(?:AKIA|ASIA|ABIA)[A-Z2-7]{16}\b", 3.0),
    ("slack_token", ("xoxb-", "xoxp-", "xoxa-", "xoxe"), r"\bxox[abpe](?:\.xox[bp])?-[0-9A-Za-z-]{10,}", 2.0),
    ("slack_webhook", ("hooks.slack.com",), r"https?://hooks\.slack\.com/(?:services|workflows)/[A-Za-z0-9+/]{20,}", 0.0),
    ("stripe_key", ("sk_live", "sk_test", "rk_live", "rk_test"), r"\b[sr]k_(?:live|test)_[A-Za-z0-9]{16,}", 2.0),
    ("google_key", ("aiza",), r"\bAIza[A-Za-z0-9_-]{35}", 3.0),
    ("npm_token", ("npm_",), r"\bnpm_[A-Za-z0-9]{36}\b", 2.0),
    ("pypi_token", ("pypi-",), r"\bpypi-[A-Za-z0-9_-]{50,}", 3.0),
    ("sendgrid_key", ("sg.",), r"\bSG\.[A-Za-z0-9_=-]{16,}\.[A-Za-z0-9_=-]{16,}", 2.0),
    ("model_key", ("sk-",), r"\bsk-[A-Za-z0-9_-]{20,}", 3.0),
    ("twilio_key", ("sk",), r"\bSK[0-9a-f]{32}\b", 3.0),
    ("json_web_token", ("eyj",), r"\beyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 3.0),
    ("private_key", ("private key",), r"-----BEGIN [A-Z ]*PRIVATE KEY(?: BLOCK)?-----(?:[\s\S]*?-----END [A-Z ]*PRIVATE KEY(?: BLOCK)?-----)?", 0.0),
    ("bearer", ("bearer ",), r"(?i)\bbearer ([A-Za-z0-9._~+/-]{20,}=*)", 3.0),
    ("url_password", ("://",), r"\b[a-z][a-z0-9+.-]*://[^\s/:@]+:([^\s/@]{3,})@", 0.0),
    ("assigned", ("key", "secret", "token", "passw", "pwd", "credential"), r"""(?i)[a-z0-9_.-]*(?:api[_-]?key|secret|token|passw(?:or)?d|passwd|pwd|credential)s?["']?\s*(?:=|:|:=|=>)\s*["'`]?([A-Za-z0-9_.=+/~!@#$%^&*-]{8,150})""", 3.0),
)
#: What looks like a secret and is none: place holders, paths, names of variables.
ALLOWED = regex.compile(r"(?i)^(?:true|false|null|none|undefined|x{3,}|\*{3,}|\.{3,}|<[^>]*>|\$\{?[a-z_][a-z0-9_]*\}?|process\.env.*|os\.environ.*|your[_-].*|example.*|changeme|placeholder.*|redacted.*|[a-z_.]+\(.*|(?:/[a-z0-9._-]+)+|[a-z]+(?:[_.-][a-z]+)*)$")
WORDS = tuple(sorted({w for _, ws, _, _ in RULES for w in ws}))


def entropy(s: str) -> float:
    """Bits per character."""
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values()) if s else 0.0


@lru_cache(1)
def _compiled() -> tuple:
    return tuple((name, words, regex.compile(p), least) for name, words, p, least in RULES)


def find_secrets(text: str | None) -> list[tuple[int, int, str]]:
    """(start, stop, rule) of every secret, in order and without overlap; none in null and short texts."""
    if not text or len(text) < 8:
        return []
    low, hits = text.lower(), []
    for name, words, pattern, least in _compiled():
        if any(w in low for w in words):
            for m in pattern.finditer(text):
                g = 1 if m.lastindex and m[1] else 0
                if m[g] and not (least and entropy(m[g]) < least) and not ALLOWED.match(m[g]):
                    hits.append((m.start(g), m.end(g), name))
    out: list[tuple[int, int, str]] = []
    for h in sorted(hits, key=lambda x: (x[0], -x[1])):
        if not out or h[0] >= out[-1][1]:
            out.append(h)
    return out


def redacted(text: str | None) -> str | None:
    """The text with ``[redacted:<rule>]`` in place of each secret."""
    out, at = [], 0
    for a, b, name in find_secrets(text):
        out += [text[at:a], f"[redacted:{name}]"]
        at = b
    return text if not out else "".join(out) + text[at:]


def redacted_deep(value):
    """``value`` with every string in it redacted, in lists and objects, too; keys stay."""
    if isinstance(value, str):
        return redacted(value)
    if isinstance(value, list):
        return [redacted_deep(v) for v in value]
    return {k: redacted_deep(v) for k, v in value.items()} if isinstance(value, dict) else value


def may_hold(c: Column) -> Column:
    """The native test: True where a text holds one of the words."""
    low = F.lower(c)
    hit = F.contains(low, F.lit(WORDS[0]))
    for w in WORDS[1:]:
        hit = hit | F.contains(low, F.lit(w))
    return F.coalesce(hit, F.lit(False))


@F.pandas_udf(StringType())
def _redact(s: pd.Series) -> pd.Series:
    return s.map(redacted)


@F.pandas_udf(StringType())
def _redact_json(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else json.dumps(redacted_deep(json.loads(x)), ensure_ascii=False, separators=(",", ":")))


def redact_column(c: Column) -> Column:
    """A text column without its secrets."""
    return F.when(may_hold(c), _redact(c)).otherwise(c)


def redact_rows(df: DataFrame) -> DataFrame:
    """``df`` with the secrets of every string replaced, in structs, arrays and maps, too; other values stay as they are."""
    out = []
    for f in df.schema.fields:
        kind, c = f.dataType.simpleString(), F.col(f"`{f.name}`")
        if kind == "string":
            out.append(redact_column(c).alias(f.name))
        elif "string" in kind and kind.startswith(("struct", "array", "map")):
            text = F.to_json(c)
            out.append(F.when(may_hold(text), F.from_json(_redact_json(text), f.dataType)).otherwise(c).alias(f.name))
        else:
            out.append(c)
    return df.select(*out)


def secrets_in(texts: DataFrame) -> DataFrame:
    """(key, rule, start, stop) of every secret of ``texts`` (key, text)."""

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(k, name, a, b) for k, t in zip(pdf["key"].array, pdf["text"].array) for a, b, name in find_secrets(t)], columns=["key", "rule", "start", "stop"])

    return texts.where(may_hold(F.col("text"))).select("key", "text").mapInPandas(kernel, "key string, rule string, start int, stop int")
