"""Cut long texts at natural boundaries by dynamic programming.

Units are the pre-split words of the tokenizer (a word too long for that is
replaced by its tokens), so the length of any piece is a difference of running
sums. Boundaries have penalties by how natural they are. The programme picks
the ends of the pieces that minimise penalties and size imbalance, where every
piece but the first starts about ``overlap`` tokens before the end of the one
before, and none is longer than ``max_tokens``.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.llm.bpe import DEFAULT_TOKENIZER, MergeAutomaton, automaton, broadcast_spec

#: Penalty and name of a cut: at a blank line, a line's end, a sentence's end, a clause's end, between words, elsewhere.
CUTS = (("paragraph", 0.0), ("line", 0.5), ("sentence", 1.0), ("clause", 3.0), ("word", 6.0), ("inside", 20.0))
_PARAGRAPH, _LINE, _SENTENCE, _CLAUSE, _WORD, _INSIDE = range(6)
#: Marks that end a sentence or a clause, and what may stand between them and the next word.
_ENDS, _WIDE_ENDS, _CLAUSES, _CLOSERS = ".!?…", "。！？", ",;:", "\"'”’»)]"

PIECES = "piece int, n_pieces int, start_char bigint, end_char bigint, n_tokens int, overlap_tokens int, cut string, text string"
#: A pre-split word of more tokens than this is cut up into its tokens.
LONG_WORD = 48
# White space of the pre-split pattern (Python's own \s takes in U+001C to U+001F besides).
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Runs of other characters with the white space before them. No pre-split word goes on from another character into white
#: space, nor looks beyond it, so the words of a chunk do not depend on what stands around it.
_split_chunks = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+").findall
#: The programme's table of imbalances is filled for so many cuts at once.
_BLOCK = 64
_ROWS = np.arange(_BLOCK)


# What is kept of a word: its token count, its length and these marks, in one integer.
_BITS = 20
_BLANK, _NL1, _NL2, _SENT, _WIDE, _CLAUSE_END, _LEADS, _TRAILS, _PART = (1 << (2 * _BITS + i) for i in range(9))
_MASK = (1 << _BITS) - 1


def _facts(tok: MergeAutomaton, w: str, count: int | None = None) -> int:
    n = (len(tok.word_ids(w)) >> 2) if count is None else count
    x = min(n, _MASK) | min(len(w), _MASK) << _BITS
    if w.isspace():
        x |= _BLANK
        lines = w.count("\n")
        x |= _NL2 if lines > 1 else _NL1 if lines else 0
    else:
        core = w.rstrip(_CLOSERS) or w
        x |= _SENT if core[-1] in _ENDS else _WIDE if core[-1] in _WIDE_ENDS else _CLAUSE_END if core[-1] in _CLAUSES else 0
    if w[0].isspace():
        x |= _LEADS
    if w[-1].isspace():
        x |= _TRAILS
    return x


class _Words(dict):
    """The facts of words, kept for words met again; of a text's long words, ``long`` keeps the ids."""

    def __init__(self, tok: MergeAutomaton) -> None:
        self.tok, self.long = tok, {}

    def __missing__(self, w: str) -> int:
        if len(w) > LONG_WORD:
            if w not in self.long:
                self.long[w] = self.tok.word_ids(w)
            return _facts(self.tok, w, len(self.long[w]) >> 2)
        x = _facts(self.tok, w)
        if len(self) >= 400_000:
            self.clear()
        self[w] = x
        return x


class _Chunks(dict):
    """The facts of the words of chunks, as the bytes of an int64 array; kept for chunks met again."""

    def __init__(self, words: _Words) -> None:
        self.words = words

    def __missing__(self, c: str) -> bytes:
        words = self.words
        got = array("q", [words[w] for w in words.tok.split(c)]).tobytes()
        if len(c) <= LONG_WORD:
            if len(self) >= 400_000:
                self.clear()
            self[c] = got
        return got


class Splitter:
    """Splits texts with one tokenizer; keeps the facts of the words and chunks it met."""

    def __init__(self, tok: MergeAutomaton, max_tokens: int = 512, overlap: int = 64) -> None:
        if not 0 <= 2 * overlap < max_tokens or max_tokens < 16:
            raise ValueError("max_tokens must be at least 16 and more than twice the overlap")
        self.tok, self.max_tokens, self.overlap = tok, max_tokens, overlap
        self._words = _Words(tok)
        self._chunks = _Chunks(self._words)

    def _facts_of(self, text: str) -> np.ndarray:
        """The facts of all words of a text, chunk by chunk."""
        self._words.long.clear()
        chunks = self._chunks
        return np.frombuffer(b"".join([chunks[c] for c in _split_chunks(text)]), dtype=np.int64)

    def _long_words(self, words: list[str], facts: list[int]) -> tuple[list[str], list[int]]:
        """Long words as runs of whole-character tokens: a run of tokens out of a path is a path, so counts hold for every cut between them."""
        out_w, out_f = [], []
        for w, x in zip(words, facts):
            if x & _MASK <= LONG_WORD:
                out_w.append(w)
                out_f.append(x)
                continue
            held, k, part = b"", 0, 0
            for t in np.frombuffer(self._words.long.get(w) or self.tok.word_ids(w), dtype=np.int32).tolist():
                held += self.tok.labels[t]
                k += 1
                try:
                    s = held.decode("utf-8")
                except UnicodeDecodeError:
                    continue
                out_w.append(s)
                out_f.append(_facts(self.tok, s, k) | part)
                held, k, part = b"", 0, _PART
        return out_w, out_f

    def split(self, text: str | None) -> list[tuple]:
        """Rows of ``PIECES`` for one text; a null, empty or short text is one piece."""
        if not text:
            return [(0, 1, 0, 0, 0, 0, "end", text)]
        f = self._facts_of(text)
        total = int((f & _MASK).sum())
        if total <= self.max_tokens:
            return [(0, 1, 0, len(text), total, 0, "end", text)]
        if (f & _MASK).max() > LONG_WORD:
            f = np.array(self._long_words(self.tok.split(text), f.tolist())[1], dtype=np.int64)
        return self._pieces(text, f)

    def _pieces(self, text: str, f: np.ndarray) -> list[tuple]:
        max_tokens, overlap = self.max_tokens, self.overlap
        m = len(f)
        cum, off = np.zeros(m + 1, dtype=np.int64), np.zeros(m + 1, dtype=np.int64)
        np.cumsum(f & _MASK, out=cum[1:])
        np.cumsum(f >> _BITS & _MASK, out=off[1:])

        # kind[i] of the boundary before word i; the lowest that holds.
        kind = np.full(m + 1, _INSIDE)
        prev, this = f[:-1], f[1:]
        leads = (this & _LEADS) > 0
        inner = kind[1:m]
        inner[(leads | ((prev & _TRAILS) > 0)) & ((this & _PART) == 0)] = _WORD
        flat = leads & ((this & (_NL1 | _NL2)) == 0)
        inner[flat & ((prev & _CLAUSE_END) > 0)] = _CLAUSE
        inner[(flat & ((prev & _SENT) > 0)) | ((prev & _WIDE) > 0)] = _SENTENCE
        ended = ((prev & (_NL1 | _NL2)) > 0) & ((this & (_NL1 | _NL2)) == 0)
        before = np.zeros(m - 1, dtype=bool)
        before[1:] = (f[:-2] & (_NL1 | _NL2)) > 0
        inner[ended] = _LINE
        inner[ended & (((prev & _NL2) > 0) | before)] = _PARAGRAPH

        # Natural boundaries, and denser ones where those are far apart.
        use = kind <= _CLAUSE
        use[0], use[m] = False, True
        at = np.flatnonzero(use)
        last = np.concatenate([[0], at[:-1]])
        for a, z in zip(last[(far := cum[at] - cum[last] > max(1, (max_tokens - overlap) // 3))], at[far]):
            use[a + 1 : z] = True
        ends = np.flatnonzero(use)

        # A cut in a run of white space joins what stands before it to one word, whose count may differ.
        extra = np.zeros(len(ends), dtype=np.int64)
        blank = (f & _BLANK) > 0
        for k in np.flatnonzero((ends >= 2) & blank[ends - 1] & blank[ends - 2]):
            e = int(ends[k])
            a = e - 2
            while a and blank[a - 1]:
                a -= 1
            extra[k] = (len(self.tok.word_ids(text[off[a] : off[e]])) >> 2) - int(cum[e] - cum[a])

        # Where the piece after each cut begins: a word near the wanted overlap, else the nearest boundary.
        starts = np.flatnonzero(kind[:m] <= _WORD)
        want = cum[ends] - overlap
        begin = np.minimum(np.maximum(np.searchsorted(cum, want), 1), ends - 1)
        if len(starts):
            j = np.searchsorted(cum[starts], want)
            hi, lo = starts[np.minimum(j, len(starts) - 1)], starts[np.maximum(j - 1, 0)]
            near = np.where(np.abs(cum[hi] - want) < np.abs(cum[lo] - want), hi, lo)
            begin = np.where((np.abs(cum[near] - want) <= overlap // 2) & (near < ends), near, begin)

        # cost[k + 1]: of the best cutting whose last cut so far is ends[k].
        size_to = (cum[ends] + extra).astype(np.float64)
        from_cum = np.concatenate([[0.0], cum[begin].astype(np.float64)])
        pen = np.array([p for _, p in CUTS])[kind[ends]] + 2.0
        n_min = -(-(int(cum[m]) - overlap) // (max_tokens - overlap))
        target = (float(cum[m]) + (n_min - 1) * overlap) / n_min
        n = len(ends)
        first = np.maximum.accumulate(np.searchsorted(from_cum, size_to - max_tokens))
        order = np.arange(n)
        if (first > order).any():
            raise ValueError("a word is longer than max_tokens allows")
        cost = np.full(n + 1, np.inf)
        cost[0] = 0.0
        back = np.zeros(n + 1, dtype=np.int64)
        scale = 8.0 / target**2
        shifted = from_cum + target
        for at in range(0, n, _BLOCK):  # a block of cuts at once: after those before it, then after its own until no cost changes
            base, top = int(first[at]), min(at + _BLOCK, n)
            d = size_to[at:top, None] - shifted[base:top]
            uneven = scale * d * d
            rows, old = _ROWS[: top - at], at + 1 - base
            np.copyto(uneven, np.inf, where=order[base:top] < first[at:top, None])
            np.copyto(uneven[:, old:], np.inf, where=rows[1:] > rows[:, None])
            c = uneven[:, :old] + cost[base : at + 1]
            b = c.argmin(axis=1)
            best, b = c[rows, b], b + base
            cost[at + 1 : top + 1] = best + pen[at:top]
            while top - at > 1:
                c = uneven[:, old:] + cost[at + 1 : top]
                own = c.argmin(axis=1)
                least = c[rows, own]
                got = np.minimum(least, best) + pen[at:top]
                if np.array_equal(got, cost[at + 1 : top + 1]):
                    b = np.where(least < best, own + (at + 1), b)
                    break
                cost[at + 1 : top + 1] = got
            back[at + 1 : top + 1] = b
        cuts = []
        k = n
        while k:
            cuts.append(k)
            k = int(back[k])
        cuts.reverse()
        out, prev_cut = [], 0
        for p, k in enumerate(cuts):
            a, e = (int(begin[prev_cut - 1]) if p else 0), int(ends[k - 1])
            shared = int(cum[ends[prev_cut - 1]] - cum[a]) if p else 0
            out.append((p, len(cuts), int(off[a]), int(off[e]), int(cum[e] - cum[a] + extra[k - 1]), shared, "end" if e == m else CUTS[kind[e]][0], text[off[a] : off[e]]))
            prev_cut = k
        return out


def split_corpus(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = 512, overlap: int = 64, tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """``(id_col, *PIECES)``: every text as ordered pieces of at most ``max_tokens``.

    A text within the limit comes out whole; null and empty texts as one piece
    of no tokens; a text without any boundary is cut between characters.
    ``start_char`` and ``end_char`` count characters. Each row of a repeated id
    is cut on its own; other columns are ignored. A map without a shuffle.
    """
    spec = broadcast_spec(docs, tokenizer)
    id_type = docs.schema[id_col].dataType.simpleString()
    names = [id_col, *[x.split()[0] for x in PIECES.split(", ")]]
    kinds = [None, pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(automaton(spec.value), max_tokens, overlap)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):  # bounded output batches
                part = batch.slice(at, 512)
                rows, owner = [], []
                for i, t in enumerate(part.column(1).to_pylist()):
                    got = splitter.split(t)
                    rows += got
                    owner += [i] * len(got)
                cols = zip(*rows)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner)), *[pa.array(c, k) for c, k in zip(cols, kinds[1:])]], names=names)

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {id_type}, {PIECES}")
