"""Encoding with a public byte-level BPE tokenizer as a lazily determinised finite-state transducer (problem 8).

The transducer reads bytes. Behind every byte it knows the last token of the encoding of what it has read, because an
encoding is the right one exactly if each two neighbours in it are what the merges make of their joined bytes. A state
is the set of tokens that may be under way: (node in the trie of all tokens, token before it). States and transitions
are made when they are first met and kept. When only one start is left open, all before it is final and goes out: the
lookahead is bounded by the longest token. Decoding is a stream, too: an incremental UTF-8 automaton over token bytes.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# White space as Unicode has it, and the split pattern of the tokenizer family.
SPACE = r"\t-\r \x85\xa0  -     　"
PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")

#: Entries after which a cache is emptied; results don't depend on it.
MAX_WORDS, MAX_STEPS = 400_000, 2_000_000


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes to id of the content of a ``.tiktoken`` file, ids in order of merges."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


def default_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where the installed public tokenizer files are."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Transducer:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.trie: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        for t, i in ranks.items():
            node = 0
            for b in t:
                nxt = self.trie[node].get(b)
                if nxt is None:
                    nxt = self.trie[node][b] = len(self.trie)
                    self.trie.append({})
                    self.token_at.append(-1)
                node = nxt
            self.token_at[node] = i
        self.length = {i: len(t) for i, t in self.bytes_of.items()}
        self.neighbours: dict[tuple[int, int], bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self._clear()

    def _clear(self) -> None:
        self.states: dict[tuple, int] = {((0, -1),): 0}
        self.content: list[tuple] = [((0, -1),)]
        self.steps: dict[int, tuple[int, int, bool]] = {}

    def merged(self, data: bytes) -> list[int]:
        """The encoding by its definition, merge by merge; used for two joined tokens only."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: (self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i))
            pair = parts[best] + parts[best + 1]
            if pair not in self.ranks:
                break
            parts[best : best + 2] = [pair]
        return [self.ranks[p] for p in parts]

    def fits(self, left: int, right: int) -> bool:
        """True if the two tokens stay as they are beside each other."""
        if left < 0:
            return True
        got = self.neighbours.get((left, right))
        if got is None:
            if len(self.neighbours) > MAX_STEPS:
                self.neighbours.clear()
            got = self.neighbours[(left, right)] = self.merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return got

    def _step(self, state: int, b: int) -> tuple[int, int, bool]:
        """Builds one transition: next state, last token of all that was read, and whether that token is final."""
        open_, last = [], -1
        for node, before in self.content[state]:
            nxt = self.trie[node].get(b)
            if nxt is None:
                continue
            t = self.token_at[nxt]
            if t >= 0 and last < 0 and self.fits(before, t):
                last = t
            if self.trie[nxt]:
                open_.append((nxt, before))
        if last < 0:
            raise ValueError(f"the vocabulary has no token for byte {b}")
        key = (*open_, (0, last))
        nxt = self.states.get(key)
        if nxt is None:
            nxt = self.states[key] = len(self.content)
            self.content.append(key)
        out = self.steps[state << 8 | b] = (nxt, last, not open_)
        return out

    def piece(self, data: bytes) -> list[int]:
        """Ids of one piece of text between splits."""
        if len(self.steps) > MAX_STEPS:
            self._clear()
        out: list[int] = []
        tail: list[int] = []
        state, steps = 0, self.steps
        for b in data:
            got = steps.get(state << 8 | b) or self._step(state, b)
            state = got[0]
            tail.append(got[1])
            if got[2]:
                out += self._walk(tail)
                tail = []
        return out + self._walk(tail) if tail else out

    def _walk(self, tail: list[int]) -> list[int]:
        out, i = [], len(tail)
        while i > 0:
            t = tail[i - 1]
            out.append(t)
            i -= self.length[t]
        if i:
            raise AssertionError("a token crosses a final border")
        out.reverse()
        return out

    def encode(self, text: str) -> list[int]:
        """Ids of a text; what looks like a special token is ordinary text."""
        out: list[int] = []
        words = self.words
        for w in PIECES.findall(text):
            got = words.get(w)
            if got is None:
                got = tuple(self.piece(w.encode("utf-8", "surrogatepass")))
                if len(w) <= 64:
                    if len(words) > MAX_WORDS:
                        words.clear()
                    words[w] = got
            out += got
        return out

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """The text of a stream of ids, in the parts that become whole; unknown ids raise, broken UTF-8 gives U+FFFD."""
        machine = Utf8Stream()
        for i in ids:
            if part := machine.feed(self.bytes_of[int(i)]):
                yield part
        if part := machine.end():
            yield part


class Utf8Stream:
    """Incremental UTF-8 automaton. State: bytes held, bytes still due, and the range the next one must be in."""

    def __init__(self) -> None:
        self.held = bytearray()
        self.due = 0
        self.low, self.high = 0x80, 0xBF

    def _start(self, b: int) -> str | None:
        """Takes a first byte; gives what it is by itself, or None where more is due."""
        if b < 0x80:
            return chr(b)
        if 0xC2 <= b <= 0xDF:
            self.due, self.low, self.high = 1, 0x80, 0xBF
        elif 0xE0 <= b <= 0xEF:
            self.due, self.low, self.high = 2, 0xA0 if b == 0xE0 else 0x80, 0x9F if b == 0xED else 0xBF
        elif 0xF0 <= b <= 0xF4:
            self.due, self.low, self.high = 3, 0x90 if b == 0xF0 else 0x80, 0x8F if b == 0xF4 else 0xBF
        else:
            return "�"
        self.held = bytearray((b,))
        return None

    def feed(self, data: bytes) -> str:
        out: list[str] = []
        for b in data:
            if self.due:
                if self.low <= b <= self.high:
                    self.held.append(b)
                    self.due -= 1
                    self.low, self.high = 0x80, 0xBF
                    if not self.due:
                        out.append(self.held.decode("utf-8"))
                    continue
                self.due = 0
                out.append("�")
            if (one := self._start(b)) is not None:
                out.append(one)
        return "".join(out)

    def end(self) -> str:
        left, self.due = self.due, 0
        return "�" if left else ""


@lru_cache(2)
def transducer(vocabulary: bytes) -> Transducer:
    """One transducer per worker and vocabulary. The file's content travels with the tasks (under 1 MB): executors need no file."""
    return Transducer(read_ranks(vocabulary))


def vocabulary(path: str | None = None) -> bytes:
    """The content of a vocabulary file, read on the driver."""
    with open(path or default_path(), "rb") as f:
        return f.read()


def _encoded(documents: DataFrame, out: str, fields: list[str], give, path: str | None) -> DataFrame:
    """Runs ``give`` (the ids of each text of a batch, the batch) over batches of ``documents``, whose last column is the text."""
    held = vocabulary(path)

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(held)
        for batch in batches:
            ids = [np.array(t.encode(s), dtype=np.int32) if s else np.zeros(0, dtype=np.int32) for s in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays(give(ids, batch, t), names=fields)

    return documents.mapInArrow(kernel, out)


def _lists(ids: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(ids) if ids else np.zeros(0, dtype=np.int32)))


def encode_documents(documents: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids) of each row. Null and empty texts have the empty list; texts are whole, however long; doubled rows stay."""
    rows = documents.select(F.col(key).cast("bigint").alias(key), F.col(text).cast("string").alias(text))
    return _encoded(rows, f"{key} bigint, ids array<int>", [key, "ids"], lambda ids, batch, t: [batch.column(0), _lists(ids)], path)


def count_tokens(documents: DataFrame, carry: str, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, carry, n_tokens) of each row, 0 for null and empty texts; ``carry`` is a text column taken along."""
    rows = documents.select(F.col(key).cast("bigint").alias(key), F.col(carry).cast("string").alias(carry), F.col(text).cast("string").alias(text))
    give = lambda ids, batch, t: [batch.column(0), batch.column(1), pa.array([len(x) for x in ids], pa.int64())]
    return _encoded(rows, f"{key} bigint, {carry} string, n_tokens bigint", [key, carry, "n_tokens"], give, path)


def round_trip(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_ids, same): whether the decoded ids of each text give it back; null and empty texts come back empty."""
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def give(ids: list[np.ndarray], batch: pa.RecordBatch, t: Transducer) -> list:
        same = ["".join(t.decode(x)) == (s or "") for x, s in zip(ids, batch.column(1).to_pylist())]
        return [batch.column(0), pa.array([len(x) for x in ids], pa.int32()), pa.array(same)]

    return _encoded(rows, "doc_id bigint, n_ids int, same boolean", ["doc_id", "n_ids", "same"], give, path)


def decode_documents(encoded: DataFrame, path: str | None = None, key: str = "doc_id") -> DataFrame:
    """(key, text) of rows (key, ids); null ids give null."""
    held = vocabulary(path)

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(held)
        for batch in batches:
            texts = [None if ids is None else "".join(t.decode(ids)) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return encoded.select(key, "ids").mapInArrow(kernel, f"{key} bigint, text string")
