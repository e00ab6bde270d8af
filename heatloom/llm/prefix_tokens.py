"""Token counts of every prefix of a text, by dynamic programming over its characters.

A byte-pair encoding is decided by its adjacent tokens: a token sequence is the
encoding of its text exactly when every adjacent pair of it is the encoding of
the pair's text.  So the last token of each prefix follows from the last token of
a shorter prefix, and one pass over a text gives the exact token count of all its
prefixes.  Budget and truncation questions are then look-ups; nothing is encoded
again.

Pieces never cross from a character to a following blank, so the pass runs over
units (blanks and the word behind them) and the tables of frequent units are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from heatloom.llm.common import worker_store

#: Counts of units (and checked pairs) that a Python worker keeps; beyond them a unit is worked out anew each time.
KEEP_UNITS = 600_000
BLANK = "▁"


class PrefixCounter:
    """Prefix token counts under one sentencepiece BPE model with byte fallback."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        sp = self.sp
        usable = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in usable}
        if any(BLANK in p.lstrip(BLANK) or (p.startswith(BLANK * 2) and p.strip(BLANK)) for p in self.score):
            raise ValueError("pieces that reach over blanks are not supported")
        self.meet = {ab for p in self.score for ab in zip(p, p[1:])}
        self.ending: dict = {}  # pieces by their characters from the last one on
        for p in self.score:
            node = self.ending
            for ch in reversed(p):
                node = node.setdefault(ch, {})
            node[""] = True
        self.pairs: dict[tuple[str, str], bool] = {}
        self.single: dict[str, bool] = {}
        self.units: dict[str, int] = {}
        self.runs: dict[int, int] = {0: 0}

    def encode(self, text: str) -> list[str]:
        """The encoding itself, by merging the best adjacent pair, leftmost first; for short strings."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def stable(self, a: str, b: str) -> bool:
        """Whether the text of two adjacent tokens is encoded as these two."""
        key = (a, b)
        known = self.pairs.get(key)
        if known is None:
            known = self.encode(a + b) == [a, b]
            if len(self.pairs) < KEEP_UNITS:
                self.pairs[key] = known
        return known

    def is_token(self, piece: str) -> bool:
        known = self.single.get(piece)
        if known is None:
            known = self.single[piece] = len(piece) == 1 or (piece in self.score and self.encode(piece) == [piece])
        return known

    def cost(self, token: str) -> int:
        """Ids a token becomes: one, or its bytes where it is no piece."""
        return 1 if len(token) > 1 or token in self.score else len(token.encode("utf-8", "surrogatepass"))

    def prefixes(self, unit: str) -> tuple[list[int], list[bool]]:
        """Token count of every prefix of a unit, and whether the prefix starts with a lone blank token."""
        n, ending, is_token, pairs = len(unit), self.ending, self.is_token, self.pairs
        count, last, lone = [0] * (n + 1), [""] * (n + 1), [False] * (n + 1)
        for i in range(1, n + 1):
            node, starts, j = ending, [i - 1], i
            while j:
                j -= 1
                node = node.get(unit[j])
                if node is None:
                    break
                if "" in node and j < i - 1:
                    starts.append(j)
            for j in reversed(starts):
                t = unit[j:i]
                if j:
                    fits = pairs.get((last[j], t))
                    if fits is None:
                        fits = self.stable(last[j], t)
                    if not fits:
                        continue
                if is_token(t):
                    last[i], count[i] = t, count[j] + self.cost(t)
                    lone[i] = lone[j] if j else t == BLANK
                    break
            else:
                raise AssertionError("no encoding")
        return count, lone

    def run(self, blanks: int) -> int:
        """Tokens of blanks that stand alone."""
        known = self.runs.get(blanks)
        if known is None:
            known = self.runs[blanks] = len(self.sp.encode(" " * (blanks - 1))) if blanks > 1 else 1
        return known

    def unit(self, key: str) -> int:
        """Tokens of a word with one blank before it, or of a line break and the word behind it (no blank)."""
        known = self.units.get(key)
        if known is None:
            if len(key) > 1 and (key[-2], key[-1]) not in self.meet:  # no piece reaches over this place
                known = self.unit(key[:-1]) + self.cost(key[-1]) if len(key) < 64 else self.prefixes_of(key)
            else:
                known = self.prefixes_of(key)
            if len(self.units) < KEEP_UNITS:
                self.units[key] = known
        return known

    def prefixes_of(self, key: str) -> int:
        if key[:1] == "\n":
            return self.cost("\n") + self.prefixes(key[1:])[0][-1]
        return self.prefixes(BLANK + key)[0][-1]

    def count(self, text: str) -> int:
        """Tokens of a whole text."""
        if not text:
            return 0
        parts = text.replace(BLANK, " ").replace("\n", " \n").split(" ")
        if "" not in parts and text[0] != "\n":
            return sum(map(self.unit, parts))
        total, blanks = 0, 0
        for p in parts:
            if p[:1] == "\n":
                total, blanks = total + (self.run(blanks) if blanks else 0) + self.unit(p), 0
            elif p:
                total, blanks = total + (self.unit(p) if not blanks else self.after(blanks + 1, p)), 0
            else:
                blanks += 1
        return total + (self.run(blanks) if blanks else 0)

    def after(self, blanks: int, word: str) -> int:
        count, lone = self.prefixes(BLANK + word)
        return self.run(blanks) + count[-1] - 1 if lone[-1] else self.run(blanks - 1) + count[-1]

    def table(self, text: str) -> np.ndarray:
        """Exact token counts of text[:0], text[:1], ..., text."""
        out = np.zeros(len(text) + 1, np.int64)
        s = BLANK + text.replace(" ", BLANK)  # out[i] belongs to s[:i + 1]
        total, i, n = 0, 0, len(s)
        while i < n:
            j = i
            while j < n and s[j] == BLANK:
                j += 1
            k = j
            while k < n and s[k] != BLANK:
                k += 1
            blanks = j - i
            for b in range(1, blanks + 1):
                if i + b - 1 >= 1:
                    out[i + b - 1] = total + self.run(b)
            if k > j:
                count, lone = self.prefixes(s[j - 1 : k] if blanks else s[j:k])
                shift = 1 if blanks else 0
                for x in range(1, k - j + 1):
                    c = count[x + shift]
                    if blanks:
                        c = self.run(blanks) + c - 1 if lone[x + shift] else self.run(blanks - 1) + c
                    out[j + x - 1] = total + c
                total = int(out[k - 1])
            i = k
        return out


def counter_of(model: bytes) -> PrefixCounter:
    """The counter of this Python worker: tasks that follow each other share its tables."""
    store = worker_store()
    key = ("prefix counter", hash(model))
    if key not in store:
        store[key] = PrefixCounter(model)
    return store[key]


def token_counts(
    docs: DataFrame, model: bytes, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Exact token count of every whole text, and whether it is over a limit.

    Returns id, n_bytes, n_tokens, over_limit, one row per input row.  A NULL text
    counts as empty (0 bytes, 0 tokens); ids may be NULL or repeated; other input
    columns are not read.  ``model`` holds the bytes of the tokenizer file, so
    executors need no copy of it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(model)
        for b in batches:
            size, tokens = [], []
            for t in b.column(1):
                t = t.as_py() or ""
                size.append(len(t.encode()))
                tokens.append(counter.count(t))
            n = np.array(tokens, np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(size, pa.int64()), pa.array(n), pa.array(n > limit)],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")


def truncate_to_budget(
    docs: DataFrame, model: bytes, budget: int, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """The longest prefix of each text with at most ``budget`` tokens: id, text, n_tokens (of the prefix)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(model)
        for b in batches:
            texts, tokens = [], []
            for t in b.column(1):
                t = t.as_py() or ""
                counts = counter.table(t)
                cut = int(np.flatnonzero(counts <= budget)[-1])
                texts.append(t[:cut])
                tokens.append(int(counts[cut]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(texts, pa.string()), pa.array(tokens, pa.int64())], names=[id_col, text_col, "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, `{text_col}` string, n_tokens long")
