"""Token counts by rank-synchronous merging of ragged numpy arrays.

A pre-token is what no vocabulary piece can cross. All pre-tokens that are new to a batch stand end to end in one
array of symbols; each step finds every pre-token's pair of lowest rank and merges it in all of them at once.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import batch, prepare

NONE = np.int64(1 << 40)
SPACE = "▁"
CACHED_WORDS = 400_000


class PieceCounter:
    """Counts pieces as a sentencepiece BPE model with byte fallback and no normalisation gives them."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        pieces = [model.id_to_piece(i) for i in ids]
        order = sorted(range(len(ids)), key=lambda j: (-model.get_score(ids[j]), ids[j]))
        self.rank = {pieces[j]: r for r, j in enumerate(order)}
        symbols = {c: None for p in pieces for c in p} | dict.fromkeys(pieces)
        self.symbol = {s: i for i, s in enumerate(symbols)}
        self.n = len(self.symbol) + 1  # the last is a character of no piece
        char = np.full(0x110000, self.n - 1, np.int32)
        for s, i in self.symbol.items():
            if len(s) == 1:
                char[ord(s)] = i
        self.char = char
        pairs = {}
        for p, r in self.rank.items():
            for cut in range(1, len(p)):
                a, b = self.symbol.get(p[:cut]), self.symbol.get(p[cut:])
                if a is not None and b is not None:
                    pairs[a * self.n + b] = (r, self.symbol[p])
        keys = np.array(sorted(pairs), np.int64)
        self.keys = np.append(keys, np.iinfo(np.int64).max)
        self.ranks = np.array([pairs[k][0] for k in keys.tolist()] + [NONE], np.int64)
        self.made = np.array([pairs[k][1] for k in keys.tolist()] + [0], np.int64)
        # All occurrences of a pair may be merged at once unless a longer piece with the new symbol comes before it.
        lone = set()
        for p, r in self.rank.items():
            for q in {p[i:j] for i in range(len(p)) for j in range(i + 1, len(p) + 1)} - {p}:
                if self.rank.get(q, -1) > r:
                    lone.add(self.rank[q])
        self.alone = np.zeros(len(self.rank) + 1, bool)
        self.alone[list(lone)] = True
        #: Bytes that a character costs if it stays alone and is no piece; else one token.
        self.cost = np.ones(self.n, np.int64)
        self.bare = {i for s, i in self.symbol.items() if s not in self.rank}
        self.splits_at_space = not any(SPACE in p.lstrip(SPACE) for p in pieces)
        self.splits_at_line = "\n" not in self.symbol
        self.known: dict[str, int] = {"": 0}

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left * self.n + right
        at = np.searchsorted(self.keys, key)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], NONE), self.made[at]

    def merge_all(self, words: list[str]) -> np.ndarray:
        """The number of tokens of each pre-token, none of them empty; a space stands for the word mark."""
        text = "".join(words).replace(" ", SPACE)
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        length = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.char[points].astype(np.int64)
        odd = sym == self.n - 1
        if self.bare:
            odd |= np.isin(sym, list(self.bare))
        utf8 = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        seq = np.repeat(np.arange(len(words)), length)
        count = length.copy()
        bytes_of = np.where(odd, utf8, 1)
        last = np.zeros(len(sym), bool)
        last[np.cumsum(length) - 1] = True
        rank, made = self.pair_ranks(sym, np.append(sym[1:], 0))
        rank[last] = NONE
        extra = np.bincount(seq, bytes_of - 1, len(words)).astype(np.int64)  # as long as nothing is merged
        while True:
            head = np.flatnonzero(np.append(True, seq[1:] != seq[:-1]))
            best = np.minimum.reduceat(rank, head) if len(rank) else rank
            live = best < NONE
            if not live.any():
                break
            if not live.all():  # finished pre-tokens leave
                keep = np.repeat(live, np.diff(np.append(head, len(seq))))
                sym, seq, rank, made, last, bytes_of = (x[keep] for x in (sym, seq, rank, made, last, bytes_of))
                head = np.flatnonzero(np.append(True, seq[1:] != seq[:-1]))
                best = best[live]
            size = np.diff(np.append(head, len(seq)))
            at = np.flatnonzero(rank == np.repeat(best, size))
            of = seq[at]
            first = np.append(True, of[1:] != of[:-1])
            run = np.append(True, at[1:] != at[:-1] + 1) | first  # overlapping candidates: every other one of a run
            start = np.flatnonzero(run)
            even = (np.arange(len(at)) - np.repeat(start, np.diff(np.append(start, len(at))))) % 2 == 0
            at = at[np.where(self.alone[rank[at]], first, even)]
            extra -= np.bincount(seq[at], bytes_of[at] + bytes_of[at + 1] - 2, len(words)).astype(np.int64)
            count -= np.bincount(seq[at], minlength=len(words))
            sym[at], last[at], bytes_of[at] = made[at], last[at + 1], 1
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            at = at - np.arange(len(at))
            sym, seq, rank, made, last, bytes_of = (x[keep] for x in (sym, seq, rank, made, last, bytes_of))
            touched = np.union1d(at, at[at > 0] - 1)
            after = np.minimum(touched + 1, len(sym) - 1)
            rank[touched], made[touched] = self.pair_ranks(sym[touched], sym[after])
            rank[touched[last[touched]]] = NONE
        return count + extra

    def pre_tokens(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens of a text, and its line feeds that are tokens of their own."""
        if not text:
            return [], 0
        text = " " + text.replace(SPACE, " ")
        if not self.splits_at_space:
            return [text], 0
        out: list[str] = []
        lines = text.split("\n") if self.splits_at_line else [text]
        for line in lines:
            if "  " in line or line.endswith(" "):
                out += re.findall(r" *[^ ]+| +", line)
            else:
                head, *rest = line.split(" ")
                out.append(head)
                out += [" " + w for w in rest]
        return out, len(lines) - 1

    def count(self, texts: list[str]) -> list[int]:
        split = [self.pre_tokens(t) for t in texts]
        fresh = list({w for words, _ in split for w in words} - self.known.keys())
        if len(self.known) + len(fresh) > CACHED_WORDS:
            self.known = {"": 0}
            fresh = list({w for words, _ in split for w in words} - self.known.keys())
        if fresh:
            self.known.update(zip(fresh, self.merge_all(fresh).tolist(), strict=True))
        get = self.known.__getitem__
        return [sum(map(get, words)) + lines for words, lines in split]


_COUNTERS: dict[str, PieceCounter] = {}


def counter(path: str) -> PieceCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = PieceCounter(path)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of each row; a null text counts as empty, with 0 tokens. One narrow pass.

    Without begin or end tokens. Repeated rows are counted each. Other columns of docs are not looked at.
    """
    prepare(docs.sparkSession)
    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"

    def run(batches):
        tool = counter(path)
        for b in batches:
            texts = pc.fill_null(b.column(1), "")
            size = pc.cast(pc.binary_length(texts), pa.int64())
            n, texts = [], texts.to_pylist()
            for i in range(0, len(texts), 200):
                n += tool.count(texts[i : i + 200])
            yield batch(schema, [b.column(0), size, n, [x > limit for x in n]])

    out = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, schema)
    return out.withColumnRenamed("doc_id", id_col)
