"""BPE encoding and decoding of whole texts with reuse of content-defined chunks.

A text is cut where a rolling hash over its bytes says so, so passages that documents share fall into equal chunks wherever
they stand. A worker encodes each distinct chunk once and keeps its token ids in a bounded table. A text's ids are those of
its chunks, but for the surroundings of each join, which are repaired.

Repair: the vocabulary's pre-tokens never reach over a place where an ASCII letter or digit is followed by another ASCII
character that is neither, whatever stands around it, or where a letter of many scripts is followed by a space; call it a seam. Whatever scans the text has a pre-token's end there.
So ids before a seam and ids after it don't depend on each other. A join is re-encoded from a seam in what is settled to
a seam in the next chunk, each one seam farther than needed, and it counts as repaired when the ids between the two seams
at each end are the very ids that the settled part and the chunk have there. Where they aren't, or where there is no seam
(scripts without spaces), the stretch grows: to the next seam, over the whole chunk, on into the next one, and in the end over
the whole text.

Strings of special tokens are taken out of the text first, as the library does.

Scale: one pass, no shuffle; texts go to Python once and ids come back. A chunk is encoded once by each worker, not once in
the cluster: a table for all workers would ship every text and all ids, more than the input's own size. Memory is bounded by
the table, a slice of texts and the longest text. A lost executor's tasks start with empty tables.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from . import repeats, shared
from .packing import Encoder, encoder

#: Bytes of the rolling hash, and the mean number of bytes between two cuts.
ROLL, MEAN = 16, 2048
#: Bytes of chunks that a worker keeps, and the longest chunk that it keeps.
KEPT_BYTES, KEPT_LENGTH = 1 << 24, 1 << 14
_LETTER = np.isin(np.arange(256), [*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)])
_OTHER = ~_LETTER & (np.arange(256) < 0x80)
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def cuts(data: np.ndarray, mean: int = MEAN) -> np.ndarray:
    """Places in data (bytes of UTF-8) where a chunk begins: after ROLL bytes with a low hash, never inside a character."""
    grams = repeats.gram_hashes(data.astype(np.uint64) + np.uint64(1), ROLL)
    at = np.flatnonzero(grams % np.uint64(mean) == 0) + ROLL
    at = at[at < len(data)]
    return at[(data[at] & 0xC0) != 0x80]


def seams(data: np.ndarray) -> np.ndarray:
    """Places before an ASCII character that is no letter or digit and after one that is; and before white space of ASCII
    after a character of U+00C0 to U+07FF or U+4000 to U+DFFF, none of which is white space."""
    if len(data) < 2:
        return np.zeros(0, dtype=np.int64)
    inner = (data & 0xC0) == 0x80
    two, three = (data >= 0xC3) & (data <= 0xDF), (data >= 0xE4) & (data <= 0xED)
    wide = np.zeros(len(data), dtype=bool)  # the last byte of such a character
    wide[1:] = inner[1:] & two[:-1]
    wide[2:] |= inner[2:] & inner[1:-1] & three[:-2]
    return np.flatnonzero(_LETTER[data[:-1]] & _OTHER[data[1:]] | wide[:-1] & _SPACE[data[1:]]) + 1


class Chunks:
    """Ids of texts from ids of chunks, and texts from ids."""

    def __init__(self, model: Encoder, mean: int = MEAN) -> None:
        self.model, self.mean = model, mean
        self.kept: dict[bytes, np.ndarray] = {}
        self.held = self.encoded = self.reused = self.widened = 0
        added = {t.content: i for i, t in model.model.get_added_tokens_decoder().items()}
        self.special = {content: np.array([i], dtype=np.uint32) for content, i in added.items()}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        table = byte_table(model.model)
        self.bytes = np.frombuffer(b"".join(table), dtype=np.uint8)
        self.length = np.array([len(x) for x in table], dtype=np.int64)
        self.begin = np.cumsum(self.length) - self.length

    def chunk(self, part: bytes) -> np.ndarray:
        """The chunk's own ids."""
        ids = self.kept.get(part)
        if ids is not None:
            self.reused += 1
            return ids
        ids = self._plain(part)
        self.encoded += 1
        if len(part) <= KEPT_LENGTH:
            if self.held + len(part) > KEPT_BYTES:
                self.kept, self.held = {}, 0
            self.kept[part] = ids
            self.held += len(part)
        return ids

    def _plain(self, part: bytes) -> np.ndarray:
        return np.frombuffer(self.model.encode(part.decode()), dtype="<u4")

    def ends(self, ids: np.ndarray) -> np.ndarray:
        """Where each id's bytes end."""
        return np.cumsum(self.length[ids])

    def _between(self, ids: np.ndarray, ends: np.ndarray, low: int, high: int) -> np.ndarray | None:
        """The ids of bytes low to high, None if no id ends at one of these."""
        a, b = np.searchsorted(ends, [low, high])
        if (low and (a == len(ends) or ends[a] != low)) or b == len(ends) or ends[b] != high:
            return None
        return ids[a + 1 if low else 0 : b + 1]

    def encode(self, text: str) -> np.ndarray:
        """The ids of the whole text, as the library gives them."""
        parts = self.split.split(text) if self.split else [text]
        out = [self.special[p] if k % 2 else self._joined(p.encode()) for k, p in enumerate(parts) if p]
        return np.concatenate(out) if out else np.zeros(0, dtype=np.uint32)

    def _joined(self, text: bytes) -> np.ndarray:
        data = np.frombuffer(text, dtype=np.uint8)
        at = [0, *cuts(data, self.mean).tolist(), len(text)]
        if len(at) == 2:
            return self.chunk(text)
        seam = seams(data)
        settled: list[np.ndarray] = []  # ids of text[:low], all in their final form
        low, before = 0, None  # text[low:] is open; before: (the seam before low, ids between the two)
        for k in range(len(at) - 1):
            start, stop = at[k], at[k + 1]
            if k and stop - start <= 2 * ROLL and k + 2 < len(at):
                continue  # too short to hold seams worth looking at: it stays open
            inside = seam[np.searchsorted(seam, start, "right") : np.searchsorted(seam, stop)]  # seams within the chunk
            if len(inside) < 4:
                continue  # it stays open, to be encoded with what follows
            own = self.chunk(text[start:stop])
            ends = self.ends(own)  # within the chunk
            here = 0
            if k:
                for j in range(len(inside) - 3):
                    found = self._repaired(text, low, before, int(inside[j]), int(inside[j + 1]), own, ends, start)
                    if found is not None:
                        here = int(inside[j]) - start
                        break
                    self.widened += 1
                if not here:
                    continue
                settled.append(found)
            inside = inside - start
            settled.append(own[np.searchsorted(ends, here, "right") : np.searchsorted(ends, inside[-2], "right")])
            low = int(inside[-2]) + start
            before = (int(inside[-3]) + start, own[np.searchsorted(ends, inside[-3], "right") : np.searchsorted(ends, inside[-2], "right")])
        settled.append(self._repaired(text, low, before, len(text), len(text)))
        return np.concatenate(settled) if all(x is not None for x in settled) else self._plain(text)

    def _repaired(self, text: bytes, low: int, before: tuple[int, np.ndarray] | None, high: int, beyond: int, own: np.ndarray | None = None, ends: np.ndarray | None = None, start: int = 0) -> np.ndarray | None:
        """The ids of text[low:high], from encoding one seam more at both ends; None if these disagree with the ids there."""
        origin = before[0] if before else low
        ids = self._plain(text[origin:beyond])
        places = self.ends(ids)
        if before:
            left = self._between(ids, places, 0, low - origin)
            if left is None or not np.array_equal(left, before[1]):
                return None
        if own is not None:
            right, theirs = self._between(ids, places, high - origin, beyond - origin), self._between(own, ends, high - start, beyond - start)
            if right is None or theirs is None or not np.array_equal(right, theirs):
                return None
        return ids[np.searchsorted(places, low - origin, "right") : np.searchsorted(places, high - origin, "right")]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, as the library's decode with special tokens gives it."""
        if not len(ids):
            return ""
        n = self.length[ids]
        ends = np.cumsum(n)
        where = np.arange(int(ends[-1])) + np.repeat(self.begin[ids] - (ends - n), n)
        return self.bytes[where].tobytes().decode("utf-8", "replace")


def byte_table(model) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary; those of special tokens are their strings'."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # fixed values: bytes that stand for themselves; the others follow from 256 on
    char = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(plain)))}
    added = {i: t.content for i, t in model.get_added_tokens_decoder().items()}
    out = [b""] * model.get_vocab_size(with_added_tokens=True)
    for token, i in model.get_vocab(with_added_tokens=True).items():
        out[i] = token.encode() if i in added else bytes(char[c] for c in token)
    return out


_chunks: dict[tuple, Chunks] = {}


def chunks(tokenizer_path: str, ranks_path: str, mean: int = MEAN) -> Chunks:
    """A worker's table of chunks; it lives as long as the worker, so later tasks reuse what earlier ones have encoded."""
    key = (tokenizer_path, ranks_path, mean)
    if key not in _chunks:
        _chunks[key] = Chunks(encoder(tokenizer_path, ranks_path), mean)
    return _chunks[key]


def encode(docs: DataFrame, tokenizer_path: str, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", mean: int = MEAN) -> DataFrame:
    """Per row: id, n_tokens, ids (little-endian unsigned 32-bit integers), without begin, end or added special tokens.

    Null texts count as empty: no ids. Null or repeated ids keep their own rows; other columns aren't read.
    """
    slim = docs.select(F.col(id_col).alias("id"), shared.text_or_empty(text_col).cast("binary").alias("text"))
    kind = slim.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = chunks(tokenizer_path, ranks_path, mean)
        for b in repeats._batches(batches):
            ids = [table.encode(t.decode("utf-8", "replace")) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())], names=["id", "n_tokens", "ids"])

    return slim.mapInArrow(run, f"id {kind}, n_tokens bigint, ids binary").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, tokenizer_path: str, ranks_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """The rows of encoded with the text of their ids (null: empty); out_col must be a new name."""
    schema = StructType([*encoded.schema.fields, StructField(out_col, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = chunks(tokenizer_path, ranks_path)
        for b in repeats._batches(batches, ids_col):
            texts = [table.decode(np.frombuffer(x or b"", dtype="<u4")) for x in b.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, out_col])

    return encoded.mapInArrow(run, schema)


def op12_chunk_reuse(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    both = decode(encode(shared.table(spark, sf_dir, "documents"), *paths), *paths)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
