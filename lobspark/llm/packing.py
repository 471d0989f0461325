"""Vector best-fit packing of tokenised documents into sequences.

Every piece asks for three things of a sequence: tokens, a place among its documents, and attention cost (length squared).
A sequence has a capacity of each. Pieces are taken by falling length; each goes to the open sequence that fits under
every constraint and has the best score: the smallest weighted norm of what is left, or the largest weighted
dot-product of what is asked and what is left.

What a piece asks for depends on its length only, so best-fit is run on kinds (a length and how many pieces have it)
against classes of sequences that have the same residual, on at most max_tokens rows however many documents there are.
The plan then says for the i-th piece of a length where it goes; pieces are numbered within their written partition and
length, and partitions are offset by counts. So there is no global order, no task that holds all pieces, and no unused
end of a sequence for each partition.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared

MAX_TOKENS = 2048
END_ID = 0
#: Characters whose classes all regular expression engines agree on.
PLAIN = re.compile("[\t\n\r -~ªµºÀ-ɏ¿¡«»–—‘’“”…€£§°]*")
#: Fixed value: the pre-tokens of the byte-level vocabulary.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes, those of the tokenizer in tokenizer_path.

    ranks_path has the same vocabulary as merge ranks. Both give the same ids for texts of PLAIN characters without a
    special token's string, and the ranks are several times as fast; other texts go to the tokenizer.
    """

    def __init__(self, tokenizer_path: str, ranks_path: str) -> None:
        import base64
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(tokenizer_path)
        self.special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        if PLAIN.fullmatch(text) and not any(s in text for s in self.special):
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()
        return np.array(self.model.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(*paths: str) -> Encoder:
    """A worker's encoder; it lives as long as the worker."""
    if paths not in _encoders:
        _encoders[paths] = Encoder(*paths)
    return _encoders[paths]


def cut(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; of a longer document the first may be shorter, the others are full."""
    if n <= most:
        return [(0, n)]
    first = n % most or most
    return [(0, first), *((at, most) for at in range(first, n, most))]


def pieces(docs: DataFrame, tokenizer_path: str, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = MAX_TOKENS, end_id: int = END_ID) -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32 (of the ids as little-endian unsigned 32 bits). Null text: only the end id."""
    slim = docs.select(F.col(id_col).alias("id"), shared.text_or_empty(text_col).alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path, ranks_path).encode
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                row, piece, start, length, crc = [], [], [], [], []
                for i, ids in enumerate(map(encode, part.column(1).to_pylist())):
                    ids += end
                    view = memoryview(ids)
                    for k, (s, n) in enumerate(cut(len(ids) // 4, max_tokens)):
                        row.append(i), piece.append(k), start.append(s), length.append(n)  # noqa: B018
                        crc.append(zlib.crc32(view[4 * s : 4 * (s + n)]))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names=["id", "piece", "start", "length", "ids_crc32"])

    return slim.mapInArrow(run, f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def best_fit(counts: dict[int, int], max_tokens: int = MAX_TOKENS, max_docs: int | None = None, max_cost: int | None = None, score: str = "norm", weights: tuple[float, float, float] = (1.0, 0.05, 0.05)) -> pd.DataFrame:
    """The plan for counts of pieces by length.

    Rows: length, first (number of the first piece among those of its length), pieces, sequence (first sequence),
    each (pieces to a sequence, filled one after another), offset (place of a sequence's first one).
    """
    capacity = np.array([max_tokens, max_docs or max_tokens, max_cost or max_tokens**2], dtype=np.int64)
    if any(n > max_tokens or n * n > capacity[2] for n in counts):
        raise ValueError("a piece exceeds the capacity of a sequence")
    scale, weight = capacity.astype(float), np.array(weights)
    left = np.zeros((0, 3), dtype=np.int64)  # residual capacities of each class of open sequences
    many, begin = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    plan, used = [], 0
    for length in sorted(counts, reverse=True):
        ask, rest, first = np.array([length, 1, length * length], dtype=np.int64), counts[length], 0

        def place(residual: np.ndarray, at: int, each: int, sequences: int) -> np.ndarray:
            nonlocal rest, first
            n = each * sequences
            plan.append((length, first, n, at, each, int(max_tokens - residual[0])))
            first, rest = first + n, rest - n
            return residual - each * ask

        while rest:
            fits = np.flatnonzero((left >= ask).all(axis=1))
            if len(fits):
                share, want = left[fits] / scale, ask / scale
                points = (weight * (share - want) ** 2).sum(axis=1) if score == "norm" else -(weight * share * want).sum(axis=1)
                k = fits[points.argmin()]
                residual, n, at = left[k].copy(), int(many[k]), int(begin[k])
            else:
                k, residual, at = -1, capacity.copy(), used
                n = -(-rest // int((capacity // ask).min()))
                used += n
            each = int((residual // ask).min())
            sequences = min(n, rest // each)
            new = []
            if sequences:
                new.append((place(residual, at, each, sequences), sequences, at))
            if sequences < n and rest and not (sequences and rest >= each):
                new.append((place(residual, at + sequences, rest, 1), 1, at + sequences))
                sequences += 1
            if sequences < n:
                new.append((residual, n - sequences, at + sequences))
            if k >= 0:
                left, many, begin = np.delete(left, k, axis=0), np.delete(many, k), np.delete(begin, k)
            new = [x for x in new if x[0].min() > 0]
            if new:
                left, many, begin = np.vstack([left, [x[0] for x in new]]), np.r_[many, [x[1] for x in new]], np.r_[begin, [x[2] for x in new]]
    return pd.DataFrame(plan, columns=["length", "first", "pieces", "sequence", "each", "offset"], dtype="int64")


def pack(docs: DataFrame, tokenizer_path: str, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = MAX_TOKENS, end_id: int = END_ID, max_docs: int | None = None, max_cost: int | None = None, score: str = "norm") -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, sequence_id, offset; the offsets of a sequence have no gaps.

    Null texts are documents of the end id alone; null or repeated ids keep their own pieces; an empty table gives an
    empty result. By default only max_tokens binds: a sequence can't hold more documents than tokens, nor cost more than
    max_tokens squared. Cut documents leave no order between sequences. Other columns aren't read.
    """
    found = shared.write_out(pieces(docs, tokenizer_path, ranks_path, id_col, text_col, max_tokens, end_id).withColumn("part", F.spark_partition_id()), "pieces")
    counts = shared.write_out(found.groupBy("length", "part").count(), "counts")
    total = {r.length: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most max_tokens rows
    plan = best_fit(total, max_tokens, max_docs, max_cost, score)
    before = counts.select("length", "part", (F.sum("count").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).alias("before"))
    numbered = found.withColumn("own", F.row_number().over(Window.partitionBy("part", "length").orderBy("id", "piece", "start", "ids_crc32")))
    numbered = numbered.join(before.hint("merge"), ["part", "length"]).withColumn("number", F.col("own") - 1 + F.coalesce("before", F.lit(0)))
    # the plan's size follows max_tokens, not the documents: a row for each length and class of sequences that it meets
    width = np.int64(1) << 44
    keys, (n, sequence, each, offset, first) = (plan["length"] * width + plan["first"]).to_numpy(), (plan[c].to_numpy() for c in ("length", "sequence", "each", "offset", "first"))
    order = np.argsort(keys)

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def spot(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        k = order[np.searchsorted(keys[order], length.to_numpy() * width + number.to_numpy(), side="right") - 1]
        i = number.to_numpy() - first[k]
        return pd.DataFrame({"sequence_id": sequence[k] + i // each[k], "offset": offset[k] + i % each[k] * n[k]})

    placed = numbered.withColumn("spot", spot("length", "number"))
    return placed.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "spot.sequence_id", "spot.offset")


def op4_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(shared.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
