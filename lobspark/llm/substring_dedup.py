"""Substring dedup on words by prefix-partitioned suffix trees.

Suffixes are those that begin at an anchor of repeats.py. They are dealt by a prefix of variable length: the anchor's four
words, and where too many begin with these, as many more around it as it takes (Kind.widths). Each group is one subtree in
memory, in two halves: branches to the right of the anchor and to the left, both grown word by word. Branches with one
suffix end as leaves. A window that starts d words before the anchor is the pair of an inner node of depth d on the left
and one of depth 13 - d on the right; the suffixes below both are all places of this window. So the deep inner nodes (with
depths that add up to a window) are the repeats, and their smallest id holds for each of their suffixes; windows that
follow each other make them maximal. All subtrees of a batch grow together, level by level, in arrays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from . import repeats, shared

WINDOW = 13
GRAM = 4
#: Bytes of a word that are hashed at once, and how many times so many before a word is left to the hash library.
LANE, LANES = 8, 8


_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(LANE + 1)], dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which every bit depends on all others."""
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(32)


def word_hashes(texts: pa.Array, lower: bool = False, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (without \\x20 and \\x09-\\x0D) of texts in bytes, and how many each text has.

    A word's hash is its length, into which eight of its bytes at a time are mixed; words of more than 64 bytes are left to
    the library. So words of up to eight bytes and one length never collide, others by chance only. lower: of the text with
    A-Z lowered.
    """
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, dtype=np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]] if len(texts) else np.zeros(0, dtype=np.uint8)
    offsets = offsets - offsets[0]
    if not len(data):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(texts), dtype=np.int64)
    if lower:
        data = data + ((data - np.uint8(65)) < 26) * np.uint8(32)
    inside = ~_SPACE[data]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    edges = np.unique(offsets[(offsets > 0) & (offsets < len(data))])
    begin[edges] = inside[edges]
    end[edges - 1] = inside[edges - 1]
    start, stop = np.flatnonzero(begin), np.flatnonzero(end) + 1
    size = stop - start
    padded = np.r_[data, np.zeros(LANE, dtype=np.uint8)]
    lanes = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))  # eight bytes from each place on
    h = _mixed(size.astype(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    live = np.flatnonzero(size <= LANE * LANES)
    for k in range(LANES):
        live = live[size[live] > LANE * k]
        if not len(live):
            break
        eight = lanes[start[live] + LANE * k] & _MASKS[np.minimum(size[live] - LANE * k, LANE)]
        h[live] = _mixed(h[live] ^ eight)
    for k in np.flatnonzero(size > LANE * LANES).tolist():
        h[k] = xxhash.xxh3_64_intdigest(data[start[k] : stop[k]].tobytes(), seed)
    return h, np.diff(np.searchsorted(start, offsets))


def _numbered(text: bytes) -> np.ndarray:
    """The text's words as integers, equal only for equal words."""
    number: dict[bytes, int] = {}
    return np.fromiter((number.setdefault(w, len(number)) for w in text.split()), dtype=np.int64)


def _branch(node: np.ndarray, words: np.ndarray, width: int) -> np.ndarray:
    """The children of nodes by one more word, for each suffix; -1 where a suffix is the only one, or has no such word."""
    out = np.full(len(node), -1, dtype=np.int64)
    alive = np.flatnonzero((node >= 0) & (words >= 0))
    _, child, many = np.unique(node[alive] * width + words[alive], return_inverse=True, return_counts=True)
    inner = many > 1
    number = np.cumsum(inner) - 1
    out[alive] = np.where(inner[child], number[child], -1)
    return out


def smallest_ids(g: np.ndarray, pieces: list[bytes], n: np.ndarray, a: np.ndarray, low: np.ndarray, window: int, most: int) -> np.ndarray:
    """least[run, d]: the smallest id of the window that starts d words before the anchor, 0 to most, for runs with such a window."""
    number: dict[bytes, int] = {}
    cut = [p.split() for p in pieces]
    sizes = np.array([len(c) for c in cut], dtype=np.int64)
    words = np.fromiter((number.setdefault(w, len(number)) for c in cut for w in c), dtype=np.int64, count=int(sizes.sum()))
    at, width = np.cumsum(sizes) - sizes + a, len(number) + 1
    end = np.cumsum(sizes)
    word = lambda k: np.where((at + k >= end - sizes) & (at + k < end), words[np.clip(at + k, 0, len(words) - 1)], -1)
    _, root, many = np.unique(g, return_inverse=True, return_counts=True)
    root = np.where(many[root] > 1, root, -1)
    right, left = [root], [root]
    for k in range(window):
        right.append(_branch(right[-1], word(k), width))
    for k in range(most):
        left.append(_branch(left[-1], word(-1 - k), width))
    least = np.repeat(low[:, None], most + 1, axis=1)
    for d in range(most + 1):
        r, f = right[window - d], left[d]
        has = np.flatnonzero((r >= 0) & (f >= 0) & (d <= a) & (d > a - n))
        if len(has):
            _, node = np.unique(r[has] * (int(f.max()) + 1) + f[has], return_inverse=True)
            best = np.full(int(node.max()) + 1, repeats.LAST)
            np.minimum.at(best, node, low[has])
            least[has, d] = best[node]
    return least


def _solve(window: int, gram: int):
    def solve(rows: dict) -> list[list[tuple[int, int, int]]]:
        n, a, high = (rows[c].astype(np.int64) for c in ("n", "a", "high"))
        least = smallest_ids(rows["g"], rows["piece"], n, a, rows["low"], window, window - gram)
        d = np.arange(window - gram + 1)
        there = (d <= a[:, None]) & (d > (a - n)[:, None])
        hit = there & (least < high[:, None])
        out: list[list[tuple[int, int, int]]] = [[] for _ in n]
        run, back = np.nonzero(hit)
        value, start = least[run, back], a[run] - back
        order = np.lexsort((start, value, run))
        for r, v, s in zip(run[order].tolist(), value[order].tolist(), start[order].tolist(), strict=True):
            held = out[r]
            if held and held[-1][0] == v:
                held[-1] = (v, min(held[-1][1], s), max(held[-1][2], s + 1))
            else:
                held.append((v, min(held[-1][1], s), max(held[-1][2], s + 1)) if held else (v, s, s + 1))
        return out

    return solve


def kind(window: int = WINDOW) -> repeats.Kind:
    gram = min(GRAM, window)
    return repeats.Kind(size=window, gram=gram, hashes=word_hashes, numbered=_numbered, parts=bytes.split, piece=lambda words, first, n: b" ".join(words[first : first + n]), repeated="low < high", widths=(4, 1), solve=_solve(window, gram))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, group: int = repeats.GROUP) -> DataFrame:
    """Removes each word that is covered by a window of words that also starts in a row with a smaller id.

    Per row: id, n_words, n_removed, kept_sha256 (of the kept words joined by one space), spans (first word and number of
    words of each removed run). Ids may be of any type that sorts. Null texts have no words; null ids come after all others;
    rows of one id don't affect each other. Other columns aren't read.
    """
    texts = repeats.base(docs, id_col, text_col)
    found = texts.join(repeats.marks(texts, kind(window), group), "row", "left")
    id_kind = texts.schema["id"].dataType.simpleString()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in repeats._batches(batches):
            texts = b.column("text").to_pylist()
            who, first, last = repeats.covered(b.column("spans"), len(texts))
            ends = np.cumsum(np.bincount(who, minlength=len(texts))).tolist()
            removed = np.bincount(who, weights=last - first, minlength=len(texts)).astype(np.int64)
            sha, n_words, at, low, high = [], [], 0, first.tolist(), last.tolist()
            for text, end in zip(texts, ends, strict=True):
                words = text.split()
                n_words.append(len(words))
                for k in range(end - 1, at - 1, -1):
                    del words[low[k] : high[k]]
                at = end
                sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
            offsets = pa.array(np.r_[0, ends].astype(np.int32))
            spans = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in (first, last - first)], names=["first", "n"]))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n_words, pa.int64()), pa.array(removed), pa.array(sha, pa.string()), spans], names=["id", "n_words", "n_removed", "kept_sha256", "spans"])

    out = found.select("id", "text", "spans").mapInArrow(apply, f"id {id_kind}, n_words bigint, n_removed bigint, kept_sha256 string, spans array<struct<first:int,n:int>>")
    return out.withColumnRenamed("id", id_col)


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return substring_dedup(shared.table(spark, sf_dir, "documents")).drop("spans")


SQL = """
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents
), s AS (
  SELECT doc_id, unnest(range(1, len(words) - 11)) AS p, words FROM w
), t AS (
  SELECT doc_id, p, md5(array_to_string(words[p:p + 12], ' ')) AS h FROM s
), f AS (
  SELECT h, min(doc_id) AS least FROM t GROUP BY h
), r AS (
  SELECT DISTINCT t.doc_id, unnest(range(t.p, t.p + 13)) AS p FROM t JOIN f USING (h) WHERE f.least < t.doc_id
), g AS (
  SELECT doc_id, list(p) AS gone FROM r GROUP BY doc_id
), k AS (
  SELECT w.doc_id, w.words, coalesce(g.gone, []) AS gone FROM w LEFT JOIN g USING (doc_id)
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(list_filter(words, lambda x, i: NOT list_contains(gone, i)), ' '), '')) AS kept_sha256
FROM k
"""
