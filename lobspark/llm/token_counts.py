"""Token counts of a piece vocabulary with byte fallback, by rank-synchronous array merging.

Texts are cut into pre-tokens at places that no piece of the vocabulary spans, so pre-tokens can be merged one by one and
repeats counted once. A batch of distinct pre-tokens is one ragged numpy array of symbols. In each round every sequence
merges the leftmost of its lowest-ranked pairs, all sequences at once; sequences without a pair leave. The surviving
symbols are counted: one token for a piece, one for each UTF-8 byte of a character that the vocabulary lacks.

Scale: one pass, no shuffle. A worker keeps a table of pre-tokens that it has counted, cleared at a fixed size, so memory
doesn't grow with the input.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: Pre-tokens kept by a task, and those longer than this are not kept.
KEPT, KEPT_LENGTH = 1_000_000, 64
LIMIT = 4096
MARK = "▁"
NONE = np.int64(1) << 62


class Pieces:
    """The vocabulary as arrays: symbols are piece ids, or size + code point for characters that are no piece."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = size = model.get_piece_size()
        plain = {}
        for i in range(size):
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                plain[model.id_to_piece(i)] = i
        order = sorted(plain, key=lambda p: (-model.get_score(plain[p]), plain[p]))
        rank = {p: k for k, p in enumerate(order)}
        symbol = lambda part: plain.get(part, size + ord(part) if len(part) == 1 else -1)
        pairs = [(symbol(p[:k]) * (size + 0x110000) + symbol(p[k:]), rank[p], i) for p, i in plain.items() for k in range(1, len(p)) if symbol(p[:k]) >= 0 and symbol(p[k:]) >= 0]
        pairs.sort()
        self.keys, self.ranks, self.into = (np.array(x, dtype=np.int64) for x in zip(*pairs, strict=True))
        self.char = {p: i for p, i in plain.items() if len(p) == 1}
        # two neighbouring characters that no piece holds can't be merged over
        self.spanned = np.unique(np.array([ord(a) << 32 | ord(b) for p in plain for a, b in zip(p, p[1:], strict=False)], dtype=np.int64))
        self.start_ok = not any(MARK in p.lstrip(MARK) for p in plain)
        self.table = np.arange(0x110000, dtype=np.int64) + size
        for p, i in self.char.items():
            self.table[ord(p)] = i
        points = np.arange(0x110000)
        self.bytes = np.where(self.table < size, 1, 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)).astype(np.int64)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair; rank NONE where there is none."""
        key = left * (self.size + 0x110000) + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = self.keys[at] == key
        return np.where(found, self.ranks[at], NONE), np.where(found, self.into[at], -1)

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each pre-token (none empty)."""
        if not texts:
            return np.zeros(0, dtype=np.int64)
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        # cut further where no piece spans the boundary; the counts are added up at the end
        text = np.repeat(np.arange(len(texts)), lengths)
        cut = np.ones(len(points), dtype=bool)
        near = points[:-1] << 32 | points[1:]
        at = np.minimum(np.searchsorted(self.spanned, near), len(self.spanned) - 1)
        cut[1:] = (self.spanned[at] != near) | (text[1:] != text[:-1])
        seq, owner = np.cumsum(cut) - 1, text[cut]
        sym = self.table[points]
        total = np.zeros(len(owner), dtype=np.int64)
        rank, into = self._pair_ranks(sym, seq)
        while len(sym):
            first = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            low = np.minimum.reduceat(rank, first)
            size = np.diff(np.r_[first, len(sym)])
            open_ = low < NONE
            if not open_.all():  # nothing to merge any more: count what survives
                stay = np.repeat(open_, size)
                gone = ~stay
                cost = np.where(sym[gone] < self.size, 1, self.bytes[np.maximum(sym[gone] - self.size, 0)])
                np.add.at(total, seq[gone], cost)
                sym, seq, rank, into = sym[stay], seq[stay], rank[stay], into[stay]
                size, low = size[open_], low[open_]
                if not len(sym):
                    break
                first = np.cumsum(size) - size
            hits = np.flatnonzero(rank == np.repeat(low, size))
            hit = hits[np.r_[True, seq[hits[1:]] != seq[hits[:-1]]]]  # the leftmost of each sequence
            sym[hit] = into[hit]
            keep = np.ones(len(sym), dtype=bool)
            keep[hit + 1] = False
            new = hit - np.arange(len(hit))  # places after the removal; one symbol a sequence goes
            sym, seq, rank, into = sym[keep], seq[keep], rank[keep], into[keep]
            for at in (new, new - 1):
                at = at[at >= 0]
                after = at + 1 < len(sym)
                at = at[after]
                same = seq[at] == seq[at + 1]
                r, m = self.rank_of(sym[at], sym[at + 1])
                rank[at], into[at] = np.where(same, r, rank[at]), np.where(same, m, into[at])
                rank[at[~same]] = NONE
            rank[-1] = NONE
        return np.bincount(owner, weights=total, minlength=len(texts)).astype(np.int64)

    def _pair_ranks(self, sym: np.ndarray, seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank, into = np.full(len(sym), NONE), np.full(len(sym), -1, dtype=np.int64)
        inside = np.flatnonzero(seq[1:] == seq[:-1])
        if len(inside):
            rank[inside], into[inside] = self.rank_of(sym[inside], sym[inside + 1])
        return rank, into


class Counter:
    """Counts whole texts; keeps the counts of short pre-tokens it has met."""

    def __init__(self, path: str) -> None:
        self.pieces, self.kept = Pieces(path), {}
        self.runs = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+") if self.pieces.start_ok else re.compile("(?s).+")

    def pre_tokens(self, text: str) -> list[str]:
        """The text as the library normalises it (a mark in front and for each space), cut before each run of marks."""
        if not text:
            return []
        if self.pieces.start_ok and "  " not in text and MARK not in text and text[-1] != " " and text[0] != " ":
            return text.split(" ")  # each stands for itself with one mark in front
        return self.runs.findall(MARK + text.replace(" ", MARK))  # each begins with a mark of its own

    def count(self, texts: list[str]) -> list[int]:
        cut = [self.pre_tokens(x) for x in texts]
        new = list(set().union(*cut).difference(self.kept)) if cut else []
        if len(self.kept) + len(new) > KEPT:
            self.kept = {}
            new = list(set().union(*cut))
        counts = self.pieces.count([x if x[0] == MARK else MARK + x for x in new]).tolist()
        met = dict(zip(new, counts, strict=True))
        self.kept.update(met)
        out = [sum(map(self.kept.__getitem__, x)) for x in cut]
        for x in new:
            if len(x) > KEPT_LENGTH:
                del self.kept[x]
        return out


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """A worker's counter; it lives as long as the worker, so later tasks use what earlier ones have counted."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """Per row: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Null texts count as empty: no bytes, no tokens. Null or repeated ids keep their own rows; other columns aren't read.
    """
    slim = docs.select(F.col(id_col).alias("id"), shared.text_or_empty(text_col).alias("text"))
    kind = slim.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model_path).count
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = part.column(1).to_pylist()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(count(texts), pa.int64())], names=["id", "n"])

    sized = slim.select(F.struct("id", F.octet_length("text").cast("long").alias("n_bytes")).alias("id"), "text")
    found = sized.mapInArrow(run, f"id struct<id:{kind},n_bytes:bigint>, n bigint")
    return found.select(F.col("id.id").alias(id_col), F.col("id.n_bytes").alias("n_bytes"), F.col("n").alias("n_tokens"), (F.col("n") > limit).alias("over_limit"))


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(shared.table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
