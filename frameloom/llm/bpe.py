"""Byte-level BPE as a deterministic automaton over token labels.

Start with one state per byte, every byte allowed after every byte. Each
merge (u, v), in order of rank, is one gadget on this automaton:

* the arc u -> v is taken away, since the two now never stand side by side;
* a state for the new token uv is added. It is entered from where u could be
  entered, and left for where v could be left.

After all merges a sequence of tokens is BPE's own encoding of its text
exactly if it is a path, so for each text there is one path and no choice.
The gadgets only ever copy or remove arcs, so whether one arc is there can be
told from the births of its two tokens without building the whole square:
:meth:`MergeAutomaton.arc` replays the gadgets that touched that arc and keeps
the answer. Encoding walks a byte trie of the labels from every reached
position and follows the arcs that exist; decoding emits the labels.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the public pre-split pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


def _byte_of_char() -> dict[str, int]:
    """Which byte a character of the vocabulary file stands for: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    return out | {chr(256 + i): b for i, b in enumerate(rest)}


class MergeAutomaton:
    """Encoder and decoder compiled from a vocabulary and its merges."""

    def __init__(self, spec: str) -> None:
        model = json.loads(spec)["model"]
        of_char = _byte_of_char()
        label = lambda s: bytes(of_char[c] for c in s)
        self.labels: dict[int, bytes] = {i: label(s) for s, i in model["vocab"].items() if all(c in of_char for c in s)}
        ids = {b: i for i, b in self.labels.items()}
        n = max(self.labels) + 1
        self.birth, self.left, self.right = [-1] * n, [-1] * n, [-1] * n
        self.removed: dict[tuple[int, int], int] = {}
        self._known: dict[tuple[int, int], bool] = {}
        dead = set()
        for rank, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            u, v = ids[label(a)], ids[label(b)]
            t = ids[self.labels[u] + self.labels[v]]
            if self.birth[t] < 0:
                self.birth[t], self.left[t], self.right[t] = rank, u, v
                # A gadget without its arc never fires; its token has no state.
                if u in dead or v in dead or not self._arc_before(u, v, rank):
                    dead.add(t)
            self.removed.setdefault((u, v), rank)
        self.edge: dict[int, int] = {}
        self.token_at: dict[int, int] = {}
        nodes = 1
        for i, b in self.labels.items():
            if i in dead:
                continue
            at = 0
            for x in b:
                k = at << 8 | x
                at = self.edge.get(k, 0)
                if not at:
                    at = self.edge[k] = nodes
                    nodes += 1
            self.token_at[at] = i
        self._cache: dict[str, bytes] = {}
        self._split = regex.compile(PATTERN).findall

    def _arc_before(self, s: int, t: int, time: int) -> bool:
        birth, removed = self.birth, self.removed
        while True:
            r = removed.get((s, t))
            if r is not None and r < time:
                return False
            bs, bt = birth[s], birth[t]
            if bs < 0 and bt < 0:
                return True
            if s == t:  # born by one gadget, which copied v's arcs and u's entries
                s, t, time = self.right[s], self.left[t], bs
            elif bt > bs:  # entries of u, after this gadget took u -> v away
                t, time = self.left[t], bt + 1
            else:  # arcs of v, as they were before this gadget
                s, time = self.right[s], bs

    def arc(self, s: int, t: int) -> bool:
        """Whether token t may follow token s."""
        k = (s, t)
        got = self._known.get(k)
        if got is None:
            if len(self._known) > 2_000_000:
                self._known.clear()
            got = self._known[k] = self._arc_before(s, t, 1 << 60)
        return got

    def encode_word(self, word: bytes) -> list[int]:
        """The token ids of one pre-split word."""
        n = len(word)
        last = [-1] * (n + 1)
        edge, token_at, arc = self.edge, self.token_at, self.arc
        for i in range(n):
            s = last[i]
            if i and s < 0:
                continue
            at, j = 0, i
            while j < n:
                at = edge.get(at << 8 | word[j], 0)
                if not at:
                    break
                j += 1
                t = token_at.get(at)
                if t is not None and last[j] < 0 and (not i or arc(s, t)):
                    last[j] = t
        out = []
        while n:
            t = last[n]
            out.append(t)
            n -= len(self.labels[t])
        return out[::-1]

    def word_ids(self, word: str) -> bytes:
        """Ids of a word as the bytes of an int32 array; kept for words met again."""
        got = self._cache.get(word)
        if got is None:
            got = np.array(self.encode_word(word.encode("utf-8", "surrogatepass")), dtype=np.int32).tobytes()
            if len(word) <= 48:
                if len(self._cache) >= 400_000:
                    self._cache.clear()
                self._cache[word] = got
        return got

    def split(self, text: str) -> list[str]:
        return self._split(text)

    def encode_bytes(self, text: str) -> bytes:
        words, cache = self._split(text), self._cache
        try:  # mostly every word is known
            return b"".join([cache[w] for w in words])
        except KeyError:
            return b"".join([cache.get(w) or self.word_ids(w) for w in words])

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text; null and empty texts have none."""
        return np.frombuffer(self.encode_bytes(text), dtype=np.int32).tolist() if text else []

    def decode(self, ids: list[int]) -> str:
        """The text of a path: its labels, one after the other."""
        return b"".join(self.labels[i] for i in ids).decode("utf-8", "surrogatepass")


_LOADED: dict[int, MergeAutomaton] = {}


def automaton(spec: str) -> MergeAutomaton:
    """One compiled automaton per worker process."""
    k = hash(spec)
    if k not in _LOADED:
        _LOADED[k] = MergeAutomaton(spec)
    return _LOADED[k]


def broadcast_spec(df: DataFrame, tokenizer: str):
    """The vocabulary file, read on the driver and sent to all workers: a fixed public file of 1 to 2 MB."""
    with open(tokenizer, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode_corpus(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """``(id_col, ids)`` of every row: the token ids of its whole text, without special tokens.

    Null and empty texts give an empty list; strings of special tokens are
    ordinary text; every row comes out once, repeats too; other columns are
    ignored. A map without a shuffle.
    """
    spec = broadcast_spec(docs, tokenizer)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = automaton(spec.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):  # bounded output batches
                part = batch.slice(at, 1024)
                enc = [tok.encode_bytes(t) if t else b"" for t in part.column(1).to_pylist()]
                offsets = np.zeros(len(enc) + 1, dtype=np.int32)
                np.cumsum([len(e) >> 2 for e in enc], out=offsets[1:])
                values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(enc))])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), values)], names=[id_col, "ids"])

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {id_type}, ids array<int>")


def decode_corpus(encoded: DataFrame, *, id_col: str = "doc_id", tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """``(id_col, text)`` of encoded rows; a null list gives a null text."""
    spec = broadcast_spec(encoded, tokenizer)
    id_type = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = automaton(spec.value)
        for batch in batches:
            texts = [None if ids is None else tok.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return encoded.select(id_col, "ids").mapInArrow(run, f"`{id_col}` {id_type}, text string")
