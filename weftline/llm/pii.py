"""Personal data in free text (problem 1): a character-level bidirectional LSTM with CRF transitions, in numpy.

Texts are cut into overlapping windows. Both directions of the LSTM run over a batch of windows at once; the scores of
the tags are blended where windows overlap, each by its distance from its window's border, and one Viterbi pass over
the whole text finds the best sequence of tags. ``pii_train`` fits the model; its weights lie beside this file.
"""

from __future__ import annotations

import io
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "phone", "id_number", "address", "name")
TAGS = {(k, p): 1 + 2 * i + j for i, k in enumerate(KINDS) for j, p in enumerate("BI")}
K = 1 + 2 * len(KINDS)
#: Characters: 0 is padding, 1..95 printable ASCII, then classes.
V = 112
WINDOW, OVERLAP = 384, 96
MODEL = str(Path(__file__).with_name("pii.npz"))


@lru_cache(70_000)
def _char(c: str) -> int:
    o = ord(c)
    if 32 <= o < 127:
        return o - 31
    if c == "\n":
        return 96
    if c == "\t":
        return 97
    if c == "\r":
        return 98
    cat = unicodedata.category(c)
    base = unicodedata.normalize("NFKD", c)[0]
    if cat[0] == "L":
        if cat == "Lu":
            return 100 if base.isascii() else 102
        return 99 if base.isascii() else 101
    return {"Zs": 103, "Zl": 96, "Zp": 96, "Nd": 104, "Pd": 105, "Pi": 106, "Pf": 106, "Cf": 107, "Cc": 107, "Mn": 108}.get(cat, 109)


_ASCII = np.array([_char(chr(i)) for i in range(128)], dtype=np.int64)


def encode_chars(text: str) -> np.ndarray:
    if text.isascii():
        return _ASCII[np.frombuffer(text.encode(), dtype=np.uint8)]
    return np.fromiter(map(_char, text), dtype=np.int64, count=len(text))


def _allowed() -> np.ndarray:
    """0 where one tag may follow another, a large negative number where not; row K is the start."""
    ok = np.zeros((K + 1, K), dtype=np.float32)
    for i in range(len(KINDS)):
        ok[:, 2 + 2 * i] = -1e4
        ok[1 + 2 * i, 2 + 2 * i] = ok[2 + 2 * i, 2 + 2 * i] = 0
    return ok


class Tagger:
    """Weights ``w``: x (2, V, 4H) input, h (2, H, 4H) recurrent, o (2H, K) and b (K) scores, t (K+1, K) transitions."""

    def __init__(self, w: dict[str, np.ndarray]):
        self.w = {k: v.astype(np.float32) for k, v in w.items()}
        self.hidden = self.w["h"].shape[1]
        self.allowed = _allowed()

    @classmethod
    def fresh(cls, hidden: int, seed: int) -> Tagger:
        r = np.random.default_rng(seed)
        h = r.normal(0, 1, (2, hidden, 4, hidden))
        h = np.stack([np.stack([np.linalg.qr(h[d, :, k])[0] for k in range(4)], 1) for d in range(2)]).reshape(2, hidden, 4 * hidden)
        x = r.normal(0, 0.3, (2, V, 4 * hidden))
        x[:, :, hidden : 2 * hidden] += 1.0  # forget gates begin open
        return cls({"x": x, "h": h * 0.7, "o": r.normal(0, 0.15, (2 * hidden, K)), "b": np.zeros(K), "t": np.zeros((K + 1, K))})

    @classmethod
    def load(cls, source: str | bytes = MODEL) -> Tagger:
        """The tagger of a weights file, given by its path or by its bytes."""
        with np.load(io.BytesIO(source) if isinstance(source, bytes) else source) as f:
            return cls(dict(f))

    def save(self, path: str) -> None:
        np.savez_compressed(path, **{k: v.astype(np.float16) for k, v in self.w.items()})

    # Gates are in the order input, forget, output, candidate. The first three are sigmoids, taken as tanh of half.
    def _run(self, x: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """Hidden states (2, T, B, H) over ``x`` (2, T, B), and what the backward pass needs."""
        _, steps, n = x.shape
        hid = self.hidden
        half = np.ones(4 * hid, dtype=np.float32)
        half[: 3 * hid] = 0.5
        wx, wh = self.w["x"] * half, self.w["h"] * half
        h, c = np.zeros((2, n, hid), np.float32), np.zeros((2, n, hid), np.float32)
        out, kept = np.empty((2, steps, n, hid), np.float32), []
        side = np.arange(2)[:, None]
        for t in range(steps):
            z = np.matmul(h, wh)
            z += wx[side, x[:, t]]
            np.tanh(z, out=z)
            gates = z[:, :, : 3 * hid]
            gates *= 0.5
            gates += 0.5
            before = c
            c = z[:, :, hid : 2 * hid] * c
            c += z[:, :, :hid] * z[:, :, 3 * hid :]
            tc = np.tanh(c)
            if keep:
                kept.append((z, before, tc, h))
            h = z[:, :, 2 * hid : 3 * hid] * tc
            out[:, t] = h
        return out, kept

    @staticmethod
    def _turned(x: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Index of each row turned round within its length; padding stays behind."""
        t = np.arange(x.shape[1])[None, :]
        return np.where(t < length[:, None], length[:, None] - 1 - t, t)

    def emissions(self, x: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Scores (B, T, K) of the tags over a padded batch."""
        turn = self._turned(x, length)
        rows = np.arange(len(x))[:, None]
        both = np.stack([x.T, x[rows, turn].T])
        out, _ = self._run(both, False)
        e = out[0].transpose(1, 0, 2) @ self.w["o"][: self.hidden]
        back = out[1].transpose(1, 0, 2) @ self.w["o"][self.hidden :]
        return e + back[rows, turn] + self.w["b"]

    def loss(self, x: np.ndarray, y: np.ndarray, length: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood per character and its gradient."""
        w, hid = self.w, self.hidden
        n, steps = x.shape
        turn = self._turned(x, length)
        rows = np.arange(n)[:, None]
        both = np.stack([x.T, x[rows, turn].T])
        out, kept = self._run(both, True)
        f, b = out[0].transpose(1, 0, 2), out[1].transpose(1, 0, 2)[rows, turn]
        e = f @ w["o"][:hid] + b @ w["o"][hid:] + w["b"]
        mask = (np.arange(steps)[None, :] < length[:, None])
        trans = w["t"] + self.allowed
        # Forward and backward sums of the CRF, scaled at each step.
        em = np.exp(e - e.max(2, keepdims=True))
        tr, start = np.exp(trans[:K]), np.exp(trans[K])
        alpha, scale = np.empty((steps, n, K), np.float64), np.empty((steps, n))
        a = start * em[:, 0]
        for t in range(steps):
            if t:
                step = (a @ tr) * em[:, t]
                a = np.where(mask[:, t, None], step, a)
            s = a.sum(1)
            scale[t] = np.where(mask[:, t], s, 1.0)
            a = a / s[:, None]
            alpha[t] = a
        z = (np.log(scale) + np.where(mask, e.max(2), 0).T).sum()
        beta = np.ones((n, K))
        marg = np.empty((n, steps, K), np.float32)
        dt = np.zeros((K, K))
        for t in range(steps - 1, -1, -1):
            p = alpha[t] * beta
            marg[:, t] = p / p.sum(1, keepdims=True)
            if t:
                live = mask[:, t, None]
                nb = em[:, t] * beta
                joint = alpha[t - 1][:, :, None] * tr[None] * nb[:, None, :]
                joint /= joint.sum((1, 2), keepdims=True)
                dt += (joint * live[:, :, None]).sum(0)
                new = nb @ tr.T
                new /= new.sum(1, keepdims=True)
                beta = np.where(live, new, beta)
        gold = (np.take_along_axis(e, y[:, :, None], 2)[:, :, 0] * mask).sum()
        pairs = mask[:, 1:]
        prev, nxt = y[:, :-1][pairs], y[:, 1:][pairs]
        gold += trans[prev, nxt].sum() + trans[K, y[:, 0]].sum()
        count = float(mask.sum())
        de = marg.copy()
        np.put_along_axis(de, y[:, :, None], np.take_along_axis(de, y[:, :, None], 2) - 1, 2)
        de *= mask[:, :, None] / count
        gt = np.zeros_like(w["t"])
        np.add.at(gt, (prev, nxt), -1.0)
        gt[:K] += dt
        np.add.at(gt, (np.full(n, K), y[:, 0]), -1.0)
        gt[K] += marg[:, 0].sum(0)
        gt /= count
        g = {"t": gt.astype(np.float32), "b": de.sum((0, 1))}
        flat = de.reshape(-1, K)
        g["o"] = np.concatenate([f.reshape(-1, hid).T @ flat, b.reshape(-1, hid).T @ flat])
        df = de @ w["o"][:hid].T
        db = (de @ w["o"][hid:].T)[rows, turn]  # turning is its own inverse
        dout = np.stack([df.transpose(1, 0, 2), db.transpose(1, 0, 2)])
        gx, gh = np.zeros_like(w["x"]), np.zeros_like(w["h"])
        dh, dc = np.zeros((2, n, hid), np.float32), np.zeros((2, n, hid), np.float32)
        dzs = np.empty((steps, 2, n, 4 * hid), np.float32)
        for t in range(steps - 1, -1, -1):
            zt, before, tc, h_in = kept[t]
            i, fg, o, cand = (zt[:, :, k * hid : (k + 1) * hid] for k in range(4))
            dh = dh + dout[:, t]
            dc = dc + dh * o * (1 - tc * tc)
            dz = dzs[t]
            dz[:, :, :hid] = dc * cand * i * (1 - i)
            dz[:, :, hid : 2 * hid] = dc * before * fg * (1 - fg)
            dz[:, :, 2 * hid : 3 * hid] = dh * tc * o * (1 - o)
            dz[:, :, 3 * hid :] = dc * i * (1 - cand * cand)
            gh += np.matmul(h_in.transpose(0, 2, 1), dz)
            dh = np.matmul(dz, w["h"].transpose(0, 2, 1))
            dc = dc * fg
        for d in range(2):
            one = np.zeros((steps * n, V), np.float32)
            one[np.arange(steps * n), both[d].reshape(-1)] = 1
            gx[d] = one.T @ dzs[:, d].reshape(steps * n, 4 * hid)
        return float((z - gold) / count), g | {"x": gx, "h": gh}

    def viterbi(self, e: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Best tags (B, T) of scores (B, T, K); what is behind a row's length is 0."""
        n, steps, _ = e.shape
        trans = (self.w["t"] + self.allowed).astype(np.float32)
        score = e[:, 0] + trans[K]
        back = np.empty((steps, n, K), np.int8)
        into = np.ascontiguousarray(trans[:K].T)[None]
        ends = {int(x) for x in length}
        last = np.empty((n, K), np.float32)
        for t in range(1, steps + 1):
            if t in ends:
                at = length == t
                last[at] = score[at]
            if t == steps:
                break
            both = score[:, None, :] + into
            best = both.argmax(2)
            back[t] = best
            score = np.take_along_axis(both, best[:, :, None], 2)[:, :, 0] + e[:, t]
        tags = np.zeros((n, steps), np.int8)
        cur = last.argmax(1)
        rows = np.arange(n)
        for t in range(steps - 1, -1, -1):
            live = t < length
            tags[live, t] = cur[live]
            if t:
                cur = np.where(live, back[t][rows, cur], cur)
        return tags

    def _windows(self, size: int) -> list[tuple[int, int]]:
        if size <= WINDOW:
            return [(0, size)]
        step = WINDOW - OVERLAP
        return [(a, min(a + WINDOW, size)) for a in range(0, size - OVERLAP, step)]

    def tag(self, texts: list[str], batch: int = 256) -> list[np.ndarray]:
        """Tags of each text. Windows of like length share a batch, so hardly any padding is computed."""
        chars = [encode_chars(t) for t in texts]
        windows = sorted(((b - a, i, a, b) for i, c in enumerate(chars) for a, b in self._windows(len(c)) if b > a), key=lambda x: x[0])
        out: list[np.ndarray] = [np.zeros(len(c), np.int8) for c in chars]
        blended: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        at = 0
        while at < len(windows):
            group = windows[at : at + batch]
            while len(group) > 32 and group[-1][0] > 1.15 * group[0][0] + 4:
                group = group[: len(group) * 3 // 4]
            at += len(group)
            length = np.array([g[0] for g in group])
            x = np.zeros((len(group), int(length[-1])), np.int64)
            for k, (_, i, a, b) in enumerate(group):
                x[k, : b - a] = chars[i][a:b]
            e = self.emissions(x, length)
            single = np.array([len(chars[g[1]]) <= WINDOW for g in group])
            if single.any():
                tags = self.viterbi(e[single], length[single])
                for row, g in zip(tags, [g for g, s in zip(group, single) if s]):
                    out[g[1]] = row[: g[0]]
            for k, (size, i, a, b) in enumerate(group):
                if not single[k]:
                    total, weight = blended.setdefault(i, (np.zeros((len(chars[i]), K), np.float32), np.zeros((len(chars[i]), 1), np.float32)))
                    t = np.arange(size)
                    near = np.minimum(t + 1 if a else OVERLAP, size - t if b < len(chars[i]) else OVERLAP)
                    near = np.minimum(near, OVERLAP).astype(np.float32)[:, None]
                    total[a:b] += near * e[k, :size]
                    weight[a:b] += near
        for i, (total, weight) in blended.items():
            out[i] = self.viterbi((total / weight)[None], np.array([len(chars[i])]))[0]
        return out

    def find(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """(start, stop, kind) of every personal datum of each text, in order."""
        found = []
        for text, tags in zip(texts, self.tag(texts)):
            spans = []
            for a in np.flatnonzero(tags % 2 == 1):
                b = a + 1
                while b < len(tags) and tags[b] == tags[a] + 1:
                    b += 1
                if (span := checked(text, int(a), int(b), KINDS[(tags[a] - 1) // 2])) is not None:
                    spans.append(span)
            found.append(spans)
        return found


# The exact check of a span that the model found.
AT = r"(?: ?@ ?|%40|\[at\]| ?\(at\) ?)"
DOT = r"(?:\.| ?\(dot\) ?)"
EMAIL = regex.compile(rf"[\p{{L}}\p{{N}}_.+\-]+{AT}[\p{{L}}\p{{N}}\-]+(?:{DOT}[\p{{L}}\p{{N}}\-]+)+", regex.I)


def checked(text: str, a: int, b: int, kind: str) -> tuple[int, int, str] | None:
    """The span with its edges set right, or None where it can't be one of its kind: an e-mail needs its form, a phone and an id number enough digits."""
    while a < b and (text[a].isspace() or text[a] in ",;:|<>\"'="):
        a += 1
    while a < b and (text[b - 1].isspace() or text[b - 1] in ",;:|<>\"'="):
        b -= 1
    if kind == "email":
        lo, hi = max(0, a - 64), min(len(text), b + 64)
        hits = [m for m in EMAIL.finditer(text, lo, hi) if m.start() < b and m.end() > a]
        if not hits:
            return None
        best = max(hits, key=lambda m: min(m.end(), b) - max(m.start(), a))
        a, b = best.start(), best.end()
        while text[b - 1] in ".-":
            b -= 1
    elif kind in ("phone", "id_number"):
        while b > a and text[b - 1] == ".":
            b -= 1
        if sum(c.isdigit() for c in text[a:b]) < (7 if kind == "phone" else 6):
            return None
    elif kind == "name":
        if b - a > 2 and text[b - 1] == "." and not (text[b - 2].isalpha() and (b - 3 < a or not text[b - 3].isalpha())):
            b -= 1
        if not any(c.isalpha() for c in text[a:b]):
            return None
    elif text[b - 1 : b] == ".":
        b -= 1
    return (a, b, kind) if b > a else None


@lru_cache(2)
def tagger(source: str | bytes) -> Tagger:
    """One tagger per worker. Queries send the weights (some 170 kB) with their tasks, so no executor needs the file."""
    return Tagger.load(source)


def text_blocks(claude: DataFrame) -> DataFrame:
    """(row_id, block_no, text) of the text and tool results of each record's content; null and blank texts have no row."""
    pair = F.arrays_zip(F.col("message.content.text").alias("text"), F.col("message.content.content").alias("content"))  # of the blocks, these two fields alone are read
    each = claude.select("row_id", F.posexplode(pair).alias("block_no", "b"))
    texts = each.select("row_id", "block_no", F.explode(F.array("b.text", "b.content")).alias("text"))
    return texts.where(F.col("text").rlike(r"\S"))


def find_in_texts(texts: DataFrame, path: str = MODEL) -> DataFrame:
    """(text_key, found array<struct<kind, value, start, stop>>) of the distinct texts of ``texts`` that hold personal data."""

    weights = Path(path).read_bytes()

    def kernel(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = tagger(weights)
        for pdf in batches:
            values = pdf["text"].tolist()
            found = model.find(values)
            keep = [i for i, f in enumerate(found) if f]
            yield pd.DataFrame({
                "text_key": pdf["text_key"].iloc[keep].to_numpy(),
                "found": [[{"kind": k, "value": values[i][a:b], "start": a, "stop": b} for a, b, k in found[i]] for i in keep],
            })

    distinct = texts.select("text").distinct().withColumn("text_key", F.md5("text"))
    return distinct.mapInPandas(kernel, "text_key string, found array<struct<kind: string, value: string, start: int, stop: int>>")


def found_in_blocks(blocks: DataFrame, path: str = MODEL, salts: int = 8) -> DataFrame:
    """(row_id, block_no, pii_kind, pii_text): each distinct personal datum of a block.

    A text that many blocks share is read once; the join back to its blocks is spread by salts. Nothing is cut: a text
    of any length is read whole.
    """
    keyed = blocks.select("row_id", "block_no", F.md5("text").alias("text_key"), F.pmod("row_id", F.lit(salts)).cast("int").alias("salt"))
    found = find_in_texts(blocks, path).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    hit = keyed.join(found, ["text_key", "salt"]).select("row_id", "block_no", F.explode(F.array_distinct(F.transform("found", lambda x: F.struct(x["kind"].alias("kind"), x["value"].alias("value"))))).alias("x"))
    return hit.select("row_id", "block_no", F.col("x.kind").alias("pii_kind"), F.col("x.value").alias("pii_text")).distinct()


def replaced(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with a typed placeholder such as [EMAIL] in place of each span; overlapping spans: the first, then the longer."""
    out, at = [], 0
    for a, b, kind in sorted(spans, key=lambda s: (s[0], -s[1])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
            at = b
    return "".join(out) + text[at:]


def mask_texts(blocks: DataFrame, path: str = MODEL) -> DataFrame:
    """(row_id, block_no, text) with placeholders; texts without personal data stay as they are."""

    weights = Path(path).read_bytes()

    def kernel(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = tagger(weights)
        for pdf in batches:
            values = list(dict.fromkeys(pdf["text"].tolist()))
            done = {t: replaced(t, s) for t, s in zip(values, model.find(values))}
            yield pdf.assign(text=[done[t] for t in pdf["text"]])

    return blocks.select("row_id", "block_no", "text").mapInPandas(kernel, "row_id bigint, block_no int, text string")
