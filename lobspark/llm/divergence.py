"""Source divergence audit: how the sources of a language differ in their terms, by aggregation of DuckDB shards.

1. Batches of texts are cut into terms and counted by (lang, source, term) in DuckDB; Spark adds these counts up.
2. Rows are hashed by (lang, term) to shards, so a shard has all sources of its terms. DuckDB keeps the terms that enough
   documents of a language have, and Spark adds up how many there are and how often they occur.
3. For each shard, DuckDB makes probabilities of counts and sums, for each pair of sources, what its terms add to the pair's
   difference; and it ranks the terms of each source. Spark merges sums and rankings.

Of a pair's difference, terms that neither source has are known from the two sources' totals alone: |b - b'| each, with b
a source's probability of a term it doesn't have. So the shards only visit (term, source) rows that occur, against the
sources of the language, and sum what exceeds |b - b'|. All arithmetic is on integers.

Scale: shuffles carry counts, never texts; counts are added up in the batch, in the task and then in Spark, so a term that
all documents have is one row a task and source. A shard is a bounded number of rows, and DuckDB sees bounded slices of
texts. What goes to each shard beside its rows are totals, one row for each source and language, far fewer than the pairs
of sources that the result holds. Lost executors: all state is in written tables; no DuckDB file outlives a batch.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared

#: Documents of a language that must have a term, and ranks of terms that are reported. Values of the contract.
LEAST_DOCS, TOP_TERMS = 30, 50
#: p = 1 + floor(UNIT * (count + PRIOR) / (N + PRIOR * V)). Fixed values of the contract.
UNIT, PRIOR = 1_000_000_000, 5
#: What a term is made of: letters of ASCII and all characters beyond it. Fixed value of the contract.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of text and rows that DuckDB counts at once; longer texts are cut between terms into pieces of PIECE bytes.
SLICE_BYTES, SLICE_ROWS, PIECE = 1 << 22, 4000, 1 << 14
#: Rows of counts in a shard.
SHARD_ROWS = 100_000

NOTHING = pa.table({n: pa.array([], pa.int64() if n == "value" else pa.string()) for n in ("lang", "source", "part", "item", "value")})
_BETWEEN = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")

COUNT_SQL = f"""
WITH t AS (
  SELECT row, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) AS term FROM texts
), d AS (
  SELECT row, term, count(*) AS n FROM t GROUP BY ALL
)
SELECT lang, source, term, CAST(sum(n) AS BIGINT) AS n, count(*) AS docs FROM d JOIN docs USING (row) GROUP BY ALL
"""
KEEP_SQL = """
WITH k AS (
  SELECT lang, term FROM counts GROUP BY lang, term HAVING sum(docs) >= {least}
)
SELECT lang, source, term, n, row_number() OVER (PARTITION BY lang, term ORDER BY source) = 1 AS leads FROM counts JOIN k USING (lang, term)
"""
#: probabilities of the rows that occur (p), those of absent terms (base), and the languages' (q)
_SHARES = f"""
WITH base AS (
  SELECT lang, source, total, terms, {UNIT}::HUGEINT * {PRIOR} // (total + {PRIOR} * terms) + 1 AS b FROM totals
), p AS (
  SELECT k.lang, k.source, k.term, {UNIT}::HUGEINT * (k.n + {PRIOR}) // (total + {PRIOR} * terms) + 1 AS p, b FROM kept k JOIN base USING (lang, source)
)"""
PAIR_SQL = f"""{_SHARES}
SELECT x.lang, least(x.source, o.source) AS source, greatest(x.source, o.source) AS item,
       CAST(sum(abs(x.p - coalesce(y.p, o.b)) - abs(x.b - o.b)) AS BIGINT) AS value
FROM p x JOIN base o ON o.lang = x.lang AND o.source <> x.source LEFT JOIN p y ON y.lang = x.lang AND y.term = x.term AND y.source = o.source
WHERE y.p IS NULL OR x.source < o.source
GROUP BY ALL
"""
TERM_SQL = f"""{_SHARES}, l AS (
  SELECT lang, term, sum(n) AS n FROM kept GROUP BY lang, term
), w AS (
  SELECT lang, sum(total) AS total, max(terms) AS terms FROM totals GROUP BY lang
), q AS (
  SELECT lang, term, {UNIT}::HUGEINT * (n + {PRIOR}) // (total + {PRIOR} * terms) + 1 AS q FROM l JOIN w USING (lang)
)
SELECT lang, source, term AS item, CAST(p - q AS BIGINT) AS value FROM p JOIN q USING (lang, term) WHERE p > q
QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) <= {{top}}
"""


def _duck():
    import duckdb

    return duckdb.connect(config={"threads": 1, "memory_limit": "600MB"})


def _answer(sql: str, **tables: pa.Table) -> pa.Table:
    with _duck() as con:
        for name, rows in tables.items():
            con.register(name, rows)
        return con.sql(sql).to_arrow_table()


def pieces(text: bytes, size: int = PIECE) -> list[bytes]:
    """The text in pieces of size bytes or a little more, cut where no term is."""
    out, at = [], 0
    while len(text) - at > size:
        m = _BETWEEN.search(text, at + size)
        end = m.start() if m else len(text)
        out.append(text[at:end])
        at = end
    return [*out, text[at:]] if at < len(text) or not out else out


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, pa.Table]]:
    """(row, lang, source) and (row, text) of some documents at a time."""

    def tables(held: list) -> tuple[pa.Table, pa.Table]:
        docs = pa.table({"row": pa.array(range(len(held)), pa.int32()), "lang": pa.array([x[0] for x in held], pa.string()), "source": pa.array([x[1] for x in held], pa.string())})
        cut = [(k, p) for k, x in enumerate(held) for p in pieces(x[2])]
        return docs, pa.table({"row": pa.array([k for k, _ in cut], pa.int32()), "text": pa.array([p.decode("utf-8", "replace") for _, p in cut], pa.string())})

    held, size = [], 0
    for b in batches:
        for x in zip(*(c.to_pylist() for c in b.columns), strict=True):
            held.append(x)
            size += len(x[2])
            if size >= SLICE_BYTES or len(held) >= SLICE_ROWS:
                yield tables(held)
                held, size = [], 0
    if held:
        yield tables(held)


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): how often and in how many rows a term occurs. Null text, lang and source are ''."""
    slim = docs.select(*(shared.text_or_empty(F.col(c).cast("string")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"))), shared.text_or_empty(text_col).cast("binary").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in _slices(batches):
            yield from _answer(COUNT_SQL, docs=rows, texts=texts).to_batches()

    found = slim.mapInArrow(count, "lang string, source string, term string, n bigint, docs bigint")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _shards(rows: int) -> int:
    return max(1, -(-rows // SHARD_ROWS))


def _grouped(keys: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of SHARD_ROWS rows or somewhat more of sorted batches, none of which parts rows with equal keys."""
    held, many = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        many += b.num_rows
        if many < SHARD_ROWS:
            continue
        last = [b.column(k)[-1] for k in keys]
        same = pc.and_(*(pc.equal(b.column(k), v) for k, v in zip(keys, last, strict=True)))
        at = pc.index(same, True).as_py()  # the last key may go on in the next batch
        if at:
            yield pa.Table.from_batches([*held[:-1], b.slice(0, at)])
            held, many = [b.slice(at)], b.num_rows - at
    if held:
        yield pa.Table.from_batches(held)


def divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: for each (lang, source), in part `pair` each other source of the language with
    the summed absolute difference of their term probabilities, in part `term` the terms that are likelier than in the
    language, to rank top.

    Terms are those that least_docs rows of a language have. Null text, lang and source are '', repeated rows count each,
    ids aren't read. A language without such terms has pairs of difference 0; a source without any has pairs too. An empty
    table gives no rows. Ties go to the smaller item in UTF-8.
    """
    mark = shared.written()
    counts = shared.write_out(term_counts(docs, text_col, lang_col, source_col), "counts")
    spark = docs.sparkSession

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(["lang", "term"], batches):
            yield from _answer(KEEP_SQL.format(least=int(least_docs)), counts=rows).to_batches()

    sharded = counts.repartition(max(shared.many_parts(spark), _shards(counts.count())), "lang", "term").sortWithinPartitions("lang", "term")
    kept = shared.write_out(sharded.mapInArrow(keep, "lang string, source string, term string, n bigint, leads boolean"), "kept")
    groups = docs.select(*(shared.text_or_empty(F.col(c).cast("string")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source")))).distinct()
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.when(F.col("leads"), F.lit(1))).alias("led"))
    totals = groups.join(sums, ["lang", "source"], "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("led", F.lit(0)).alias("led"))
    totals = shared.write_out(totals.join(totals.groupBy("lang").agg(F.sum("led").alias("terms")), "lang").drop("led"), "totals")

    n_shards = _shards(kept.count())
    shard = F.pmod(F.xxhash64("lang", "term"), F.lit(n_shards)).alias("shard")
    each = totals.where("terms > 0").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1)))).withColumn("shard", F.col("shard").cast("long"))

    def solve(rows: pa.Table, all_totals: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return NOTHING
        out = []
        for part, sql in (("pair", PAIR_SQL), ("term", TERM_SQL.format(top=int(top)))):
            found = _answer(sql, kept=rows, totals=all_totals)
            out.append(found.append_column("part", pa.array([part] * found.num_rows, pa.string())).select(["lang", "source", "part", "item", "value"]))
        return pa.concat_tables(out)

    partial = kept.select("lang", "source", "term", "n", shard).groupBy("shard").cogroup(each.groupBy("shard")).applyInArrow(solve, "lang string, source string, part string, item string, value bigint")
    partial = shared.write_out(partial, "partial")
    b = F.expr(f"CASE WHEN terms > 0 THEN {UNIT * PRIOR} div (total + {PRIOR} * terms) + 1 ELSE 0 END")
    base = totals.select("lang", "source", b.alias("b"), "terms")
    sums = partial.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    sums = sums.unionByName(sums.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    pairs = base.join(base.select("lang", F.col("source").alias("item"), F.col("b").alias("c")), "lang").where("source <> item")
    pairs = pairs.join(sums, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", (F.coalesce("value", F.lit(0)) + F.col("terms") * F.abs(F.col("b") - F.col("c"))).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    terms = partial.where("part = 'term'").withColumn("rank", rank).where(F.col("rank") <= top)
    out = shared.write_out(pairs.withColumn("rank", rank).unionByName(terms), "divergence")
    shared.drop_since(mark, out)
    return out


def op11_source_divergence(spark, sf_dir: str) -> DataFrame:
    return divergence(shared.table(spark, sf_dir, "documents"))


SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}') AS terms FROM documents
), o AS (
  SELECT r, lang, source, unnest(terms) AS term FROM d
), v AS (
  SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST_DOCS}
), g AS (
  SELECT DISTINCT lang, source FROM d
), c AS (
  SELECT g.lang, g.source, v.term, count(o.term) AS n FROM g JOIN v ON v.lang = g.lang LEFT JOIN o ON o.lang = g.lang AND o.source = g.source AND o.term = v.term GROUP BY ALL
), p AS (
  SELECT lang, source, term, n, 1 + ({UNIT}::HUGEINT * (n + {PRIOR})) // (sum(n) OVER s + {PRIOR} * count(*) OVER s) AS p FROM c WINDOW s AS (PARTITION BY lang, source)
), l AS (
  SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term
), q AS (
  SELECT lang, term, 1 + ({UNIT}::HUGEINT * (n + {PRIOR})) // (sum(n) OVER s + {PRIOR} * count(*) OVER s) AS q FROM l WINDOW s AS (PARTITION BY lang)
), x AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), f AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
), k AS (
  SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
         CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM f
)
SELECT * FROM k WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""
