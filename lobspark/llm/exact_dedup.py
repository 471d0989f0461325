"""Exact dedup by deterministic block naming. DataFrame functions only.

A normalised text (white space deleted) is cut into blocks of a fixed number of bytes. Distinct blocks are sorted and
numbered; then adjacent pairs of names are named in the same way, level by level, until every document has a single
integer. Two documents have the same (number of blocks, last name) if and only if their normalised texts are equal:
every level is a bijection between distinct contents and integers.

Blocks are sorted by two 64-bit digests of theirs, so that only numbers are shuffled after the first step. That these
digests tell all distinct blocks apart is verified on the data; if they ever don't, naming starts again with another
seed. So the names are free of collisions, not just unlikely to collide.

Scale: the texts are shuffled once, after a map-side distinct (a block that a third of all documents hold goes out
once a task). Names of pairs shrink by half a level; there are log2(longest text / block) levels. Joins are on names, so
hot names are split by adaptive skew joins; the name side has one row a name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

BLOCK_BYTES = 4096
BUCKETS = 4096
SALTS = 32


def normalised(text: str | Column) -> Column:
    return F.regexp_replace(shared.text_or_empty(text), shared.SPACE_CLASS + "+", "")


def _named(distinct: DataFrame, keys: list[str], name: str, *more: str) -> DataFrame:
    """Integers for the distinct rows of keys: sorted within buckets, so one bucket fits a task and no global sort is needed."""
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS))
    rank = F.row_number().over(Window.partitionBy("__bucket").orderBy(*keys))
    return distinct.withColumn("__bucket", bucket).select(*keys, *more, (F.col("__bucket") * F.lit(1 << 40) + rank).alias(name))


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, row_col: str | None = None) -> DataFrame:
    """One row per input row: id, n_points (code points of the text), text_sha256, n_blocks, name (the identity), row (a number of its own, or the
    unique one in row_col).

    Null texts count as empty; empty texts have one empty block. Rows with equal ids keep their own rows. Other columns
    are not read, so their names can't clash.
    """
    spark = docs.sparkSession
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    norm = docs.select(row.alias("row"), F.col(id_col).alias("id"), shared.text_or_empty(text_col).alias("text")).select("row", "id", F.length("text").alias("n_points"), normalised("text").alias("norm"))
    count = F.greatest(F.ceil(F.length(F.col("norm").cast("binary")) / block_bytes).cast("int"), F.lit(1))
    cut = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(F.col("norm").cast("binary"), i * block_bytes + 1, F.lit(block_bytes)))

    def digests(seed: int) -> list[Column]:
        return [F.xxhash64(F.lit(seed), "block").alias("h1"), F.xxhash64("block", F.lit(seed)).alias("h2")]

    for seed in range(100):
        cells = shared.write_out(
            norm.select("id", "n_points", "row", F.sha2(F.col("norm").cast("binary"), 256).alias("sha"), count.alias("n_blocks"), F.posexplode(cut).alias("pos", "block")).select("row", "pos", "n_blocks", *digests(seed), F.when(F.col("pos") == 0, F.struct("id", "n_points", "sha")).alias("doc")),
            "cells",
        )
        blocks = norm.select(F.explode(cut).alias("block")).select(*digests(seed), "block").distinct()
        names = blocks.groupBy("h1", "h2").agg((F.count("*") > 1).alias("clash"))
        names = shared.write_out(_named(names, ["h1", "h2"], "name", "clash"), "names")
        if names.where("clash").isEmpty():
            break
        shared.drop(cells, names)
    level = cells.join(names, ["h1", "h2"]).select("row", "pos", F.col("n_blocks").alias("left"), "n_blocks", "name", "doc")
    done = None
    while True:
        level = shared.write_out(level, "level")
        own = level.where("left = 1").select("row", "doc", "n_blocks", "name")
        done = own if done is None else done.unionByName(own)
        open_ = level.where("left > 1")
        if open_.isEmpty():
            break
        half = F.floor(F.col("pos") / 2).cast("int")
        side = lambda k: F.max(F.when(F.col("pos") % 2 == k, F.col("name")))
        pairs = open_.groupBy("row", half.alias("pos")).agg(side(0).alias("a"), F.coalesce(side(1), F.lit(-1)).alias("b"), F.max("left").alias("left"), F.max("n_blocks").alias("n_blocks"), F.max("doc").alias("doc"))
        pairs = shared.write_out(pairs, "pairs")
        level = pairs.join(_named(pairs.select("a", "b").distinct(), ["a", "b"], "name"), ["a", "b"]).select("row", "pos", F.ceil(F.col("left") / 2).cast("int").alias("left"), "n_blocks", "name", "doc")
    return done.select(F.col("doc.id").alias("id"), F.col("doc.n_points").alias("n_points"), F.col("doc.sha").alias("text_sha256"), "n_blocks", "name", "row")


def _parts(found: DataFrame) -> DataFrame:
    """Groups cut into SALTS parts by row, each with its size and its best row."""
    best = F.min(F.struct((-F.col("n_points")).alias("n"), F.col("id").isNull().alias("none"), "id", "row")).alias("best")
    return found.groupBy("n_blocks", "name", "salt").agg(F.count("*").alias("group_size"), best)


def _salted(found: DataFrame) -> DataFrame:
    return found.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Groups of equal normalised texts: doc_id, keep_id, group_size, kept, text_sha256.

    Of a group the text with the most code points stays, then the smallest id (null ids last), then the first of
    repeated rows. An empty table gives an empty result. A group's rows meet its figures in SALTS parts, so that a group
    of a third of all rows isn't one task's.
    """
    found = _salted(identities(docs, id_col, text_col, block_bytes))
    parts = shared.write_out(_parts(found), "parts")
    groups = parts.groupBy("n_blocks", "name").agg(F.sum("group_size").alias("group_size"), F.min("best").alias("best"))
    figures = parts.select("n_blocks", "name", "salt").join(groups, ["n_blocks", "name"])
    out = found.join(figures, ["n_blocks", "name", "salt"])
    return out.select(F.col("id").alias(id_col), F.col("best.id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "text_sha256")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with docs' columns, whatever their names. Rows are numbered in a written table, so that the numbers stay."""
    own = shared.free_name(docs.columns)
    numbered = shared.write_out(docs.withColumn(own, F.monotonically_increasing_id()), "rows")
    stay = _parts(_salted(identities(numbered, id_col, text_col, row_col=own))).groupBy("n_blocks", "name").agg(F.min("best").alias("best"))
    stay = stay.select(F.col("best.row").alias(own))
    return numbered.join(stay, own).select(*docs.columns)


def op9_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(shared.table(spark, sf_dir, "documents"))


SQL = """
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_points,
         regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm FROM documents
), g AS (
  SELECT norm, count(*) AS group_size, arg_min(doc_id, (-n_points, doc_id)) AS keep_id FROM d GROUP BY norm
)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g USING (norm)
"""
