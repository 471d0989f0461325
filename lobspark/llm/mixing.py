"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic. A cell's documents are taken with probability
min(1, a[source] * b[language] * c[topic]). The factors are raked: a is set so that each source's expected tokens are its
target share of the wanted fraction of all tokens, then b for each language, then c for each topic, again and again until
all three marginals fit. The cut at 1 is part of the equations, so cells that are taken whole don't spoil the marginals of
others; a source whose target is more than it has is taken whole, the sample is smaller by what it lacks, and report() says so.
A document is taken when a hash of its id falls below its cell's probability, so the sample doesn't depend on
partitions or retries.

Where the table has no topic, topics are found: words are hashed to signed places of a short vector, the mean of its
language is taken off, so that topics aren't languages again, and all documents' vectors are clustered by spherical
k-means. Vectors are whole numbers, so means and centres don't depend on the order of sums.

Scale: one pass over the texts leaves a narrow table; every round of clustering and raking is one pass over a narrow
table with map-side sums. Sources may be many: each is a row, solved where it lies. The driver holds the factors of
languages and topics, and a few hundred numbers of the clusters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from . import repeats, shared
from .substring_dedup import word_hashes

MARGINALS = ("source", "lang", "topic")
#: Clusters, places of a document's vector, candidates for the first centres, passes.
TOPICS, DIM, STARTS, PASSES = 8, 64, 64, 5
ROUNDS, TOLERANCE = 60, 1e-7
MOST = 1e9  # factors of categories that are taken whole don't grow beyond it
#: Pairs of language and topic whose factors the driver holds; cells of a dense block of sources in a task.
MOST_PAIRS, AT_ONCE = 50_000, 2_000_000


@dataclass(frozen=True)
class Targets:
    """Target shares by marginal; categories without one get their observed share to the power of flatten, rescaled.

    fraction: of all tokens, what the sample should hold. seed: of the documents' hashes.
    """

    shares: dict[str, dict[str, float]] = field(default_factory=dict)
    flatten: dict[str, float] = field(default_factory=lambda: {"source": 0.8, "lang": 0.8, "topic": 1.0})
    fraction: float = 0.7
    seed: int = 42


def vectors(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(number of words, vector of whole numbers of length DIM) of each text in bytes; texts without words have zeros."""
    hashes, sizes = word_hashes(texts, lower=True)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    place = owner * DIM + (hashes & np.uint64(DIM - 1)).astype(np.int64)
    sign = 1.0 - 2.0 * (hashes >> np.uint64(32) & np.uint64(1)).astype(float)
    v = np.bincount(place, weights=sign, minlength=len(sizes) * DIM).reshape(-1, DIM)
    v = np.sign(v) * np.sqrt(np.abs(v))
    return sizes, np.rint(v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12) * 127).astype(np.int8)


def _stacked(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.int8).reshape(-1, DIM)


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-12)


@dataclass
class Topics:
    """Mean vectors by language (whole numbers) and the centres of the topics."""

    means: dict[str, np.ndarray]
    centres: np.ndarray | None = None

    def apart(self, v: np.ndarray, langs: list[str]) -> np.ndarray:
        zero = np.zeros(DIM, dtype=np.int64)
        return v.astype(np.int64) - np.array([self.means.get(x, zero) for x in langs], dtype=np.int64).reshape(-1, DIM)

    def of(self, v: np.ndarray, langs: list[str]) -> np.ndarray:
        return (self.apart(v, langs) @ self.centres.T).argmax(axis=1)


def _sums(rows: DataFrame, key: Callable[[np.ndarray, list[str]], tuple[list, np.ndarray]]) -> dict[str, tuple[int, np.ndarray]]:
    """(rows, sum of vectors) by key, for few keys; summed where the rows lie first."""
    names = ["key", "n", *(f"v{i}" for i in range(DIM))]
    schema = StructType([StructField("key", StringType()), *(StructField(n, LongType()) for n in names[1:])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                keys, v = key(_stacked(b.column("vec")), b.column("lang").to_pylist())
                own, at = np.unique(np.array(keys, dtype=object).astype(str), return_inverse=True)
                total = np.zeros((len(own), DIM), dtype=np.int64)
                np.add.at(total, at, v)
                yield pa.RecordBatch.from_arrays([pa.array(own.tolist(), pa.string()), pa.array(np.bincount(at)), *(pa.array(c) for c in total.T)], names=names)

    got = rows.select("lang", "vec").mapInArrow(run, schema).groupBy("key").agg(*[F.sum(n).alias(n) for n in names[1:]]).collect()  # a row a key
    return {r["key"]: (r["n"], np.array(r[2:], dtype=np.int64)) for r in got}


def clusters(rows: DataFrame, topics: int = TOPICS, passes: int = PASSES) -> Topics:
    """Languages' means and topics' centres: farthest-first among a few rows that are chosen by hash, then k-means over all rows."""
    found = Topics({k: np.rint(v / n).astype(np.int64) for k, (n, v) in _sums(rows, lambda v, langs: (langs, v)).items()})
    some = rows.select("lang", "vec").distinct().orderBy(F.xxhash64("vec", "lang"), "vec", "lang").limit(STARTS).collect()
    if not some:
        return Topics({}, np.zeros((1, DIM)))
    start = _unit(found.apart(np.array([np.frombuffer(bytes(r["vec"]), dtype=np.int8) for r in some]), [r["lang"] for r in some]).astype(float))
    chosen = [0]
    while len(chosen) < min(topics, len(some)):
        chosen.append(int((start @ start[chosen].T).max(axis=1).argmin()))
    found.centres = start[chosen]
    for _ in range(passes):
        now, new = Topics(found.means, found.centres), found.centres.copy()
        for k, (_, v) in _sums(rows, lambda v, langs, now=now: (now.of(v, langs).tolist(), now.apart(v, langs))).items():
            new[int(k)] = _unit(v.astype(float)) if v.any() else new[int(k)]
        found.centres = new
        if np.array_equal(new, now.centres):
            break
    return found


def category(docs: DataFrame, name: str) -> Column:
    """A row's category: its column as text; null, or no such column: "?"."""
    return F.coalesce(F.col(name).cast("string"), F.lit("?")) if name in docs.columns else F.lit("?")


def described(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, source, lang, topic or null, n_tokens, vec), written: one pass over the texts."""
    given = category(docs, "topic") if "topic" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.struct(F.col(id_col).alias("id"), category(docs, "source").alias("source"), category(docs, "lang").alias("lang"), given.alias("topic")).alias("row"), shared.text_or_empty(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in repeats._batches(batches):
            sizes, v = vectors(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(sizes, pa.int64()), pa.array([x.tobytes() for x in v], pa.binary())], names=["row", "n_tokens", "vec"])

    found = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, n_tokens bigint, vec binary")
    return shared.write_out(found.select("row.*", "n_tokens", "vec"), "described")


def with_topics(rows: DataFrame, found: Topics | None) -> DataFrame:
    """described() rows with the topic of the nearest centre; rows keep a topic of their own where the table has one."""
    if found is None:
        return rows.drop("vec")
    kind = rows.drop("vec").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = [f"t{k}" for k in found.of(_stacked(b.column("vec")), b.column("lang").to_pylist())] if b.num_rows else []
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()) if n == "topic" else b.column(n) for n in kind.names], names=kind.names)

    return rows.mapInArrow(run, kind)


def target_shares(observed: dict[str, float], marginal: str, targets: Targets) -> dict[str, float]:
    """Shares that add up to one: the given ones, and the flattened observed shares of other categories in what they leave."""
    given = {k: v for k, v in targets.shares.get(marginal, {}).items() if k in observed}
    total = max(sum(observed.values()), 1e-300)
    flat = {k: (v / total) ** targets.flatten.get(marginal, 1.0) for k, v in observed.items() if k not in given}
    left = max(0.0, 1 - sum(given.values())) if given else 1.0
    out = given | {k: v / max(sum(flat.values()), 1e-300) * left for k, v in flat.items()}
    whole = max(sum(out.values()), 1e-300)
    return {k: v / whole for k, v in out.items()}


def _source_wants(cells: DataFrame, targets: Targets, total: float) -> DataFrame:
    """(source, want): target_shares() of sources, in a table, as they may be many; times the wanted tokens."""
    given = targets.shares.get("source", {})
    value = F.lit(None).cast("double")
    for k, v in given.items():
        value = F.when(F.col("source") == k, F.lit(float(v))).otherwise(value)
    flat = F.when(F.col("given").isNull(), F.pow(F.col("own") / F.lit(max(total, 1e-300)), F.lit(targets.flatten.get("source", 1.0)))).otherwise(0.0)
    rows = cells.groupBy("source").agg(F.sum("mass").alias("own")).withColumn("given", value).withColumn("flat", flat)
    some = rows.agg(F.sum("given"), F.sum("flat")).first()
    left = max(0.0, 1 - some[0]) if some[0] is not None else 1.0
    share = F.coalesce("given", F.col("flat") * (left / max(some[1] or 0.0, 1e-300)))
    whole = max((some[0] or 0.0) + (left if some[1] else 0.0), 1e-300)
    return rows.select("source", (share / whole * (total * targets.fraction)).alias("want"))


def source_factors(mass: np.ndarray, want: np.ndarray, w: np.ndarray) -> np.ndarray:
    """For each row a with sum(mass * min(1, a * w)) = want; MOST where the row has no more than is wanted."""
    order = np.argsort(-w, kind="stable")
    m, v = mass[:, order], w[order]
    whole = np.cumsum(m, axis=1) - m  # taken whole before each column
    rest = np.cumsum((m * v)[:, ::-1], axis=1)[:, ::-1]
    a = np.divide(want[:, None] - whole, rest, out=np.full(m.shape, MOST), where=rest > 0)
    fits = (a * v <= 1 + 1e-12) & (rest > 0)
    at = fits.argmax(axis=1)
    return np.where(fits.any(axis=1), np.clip(a[np.arange(len(m)), at], 0, MOST), MOST)


class Raking:
    """Factors of languages and topics on the driver, sources in a written table."""

    def __init__(self, cells: DataFrame, targets: Targets) -> None:
        found = cells.select("lang", "topic").distinct().limit(MOST_PAIRS + 1).collect()
        if len(found) > MOST_PAIRS:
            raise ValueError(f"more than {MOST_PAIRS} pairs of language and topic; rake coarser topics")
        pairs = sorted((r["lang"], r["topic"]) for r in found)
        self.pairs, self.targets, self.cells = pairs, targets, cells
        number = {p: k for k, p in enumerate(pairs)}
        own = np.zeros(len(pairs))
        for r in cells.groupBy("lang", "topic").agg(F.sum("mass").alias("mass")).collect():
            own[number[r["lang"], r["topic"]]] = r["mass"]
        self.total = float(own.sum())
        self.sides = []
        for j, m in ((0, "lang"), (1, "topic")):
            names = sorted({p[j] for p in pairs})
            code = np.array([names.index(p[j]) for p in pairs], dtype=np.int64)
            share = target_shares(dict(zip(names, np.bincount(code, weights=own, minlength=len(names)).tolist(), strict=True)), m, targets)
            self.sides.append((m, names, code, np.array([share[n] for n in names]) * self.total * targets.fraction))
        listed = cells.join(_source_wants(cells, targets, self.total), "source").groupBy("source", "want").agg(F.collect_list(F.struct("lang", "topic", "mass")).alias("cells"))  # of one source
        self.sources = shared.write_out(listed, "sources")
        self.w = np.ones(len(pairs))
        self.error = 0.0
        if self.total:
            self._rake()

    def _solved(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        number, w = {p: k for k, p in enumerate(self.pairs)}, self.w
        for batch in batches:
            step = max(1, min(500, AT_ONCE // max(1, len(w))))
            for at in range(0, batch.num_rows, step):
                b = batch.slice(at, step)
                cells = b.column("cells")
                flat = cells.flatten()
                where = np.array([number[p] for p in zip(flat.field(0).to_pylist(), flat.field(1).to_pylist(), strict=True)], dtype=np.int64)
                mass = np.zeros((b.num_rows, len(w)))
                mass[np.repeat(np.arange(b.num_rows), cells.value_lengths().to_numpy()), where] = flat.field(2).to_numpy()
                yield b, mass, source_factors(mass, b.column("want").to_numpy(), w)

    def _masses(self) -> np.ndarray:
        """Expected tokens of each pair of language and topic, with sources fitted."""
        solved, w = self._detached(), self.w

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(len(w))
            for _, mass, a in solved(batches):
                out += (mass * np.minimum(1, a[:, None] * w)).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(w))), pa.array(out)], names=["k", "mass"])

        out = np.zeros(len(w))
        for r in self.sources.mapInArrow(run, "k bigint, mass double").groupBy("k").agg(F.sum("mass").alias("mass")).collect():
            out[r["k"]] = r["mass"]
        return out

    def _detached(self):
        bare = Raking.__new__(Raking)
        bare.pairs, bare.w = self.pairs, self.w.copy()
        return bare._solved

    def _rake(self) -> None:
        """Until the marginals fit, or five rounds in a row bring them no nearer (targets that contradict each other); error tells."""
        best, stalled = np.inf, 0
        for _ in range(ROUNDS):
            mass = self._masses()
            scale = mass.sum() / (self.total * self.targets.fraction)  # below 1 where a source has less than its target
            self.error = max(np.abs(np.bincount(code, weights=mass, minlength=len(want)) - want * scale).max() for _, _, code, want in self.sides) / self.total
            stalled = 0 if self.error < 0.99 * best else stalled + 1
            best = min(best, self.error)
            if self.error < TOLERANCE or stalled == 5:
                break
            before = self.w
            for _, _, code, want in self.sides:
                want = want * scale
                have = np.bincount(code, weights=mass, minlength=len(want))
                factor = np.divide(want, have, out=np.ones_like(want), where=have > 0)[code]
                mass, self.w = mass * factor, np.clip(self.w * factor, 0, MOST)
            if np.abs(self.w - before).max() < 1e-12:
                break

    def probabilities(self) -> DataFrame:
        """(source, lang, topic, weight, probability) of each cell; weight is before the cut, and 1 on the whole."""
        solved, w, pairs, fraction = self._detached(), self.w, self.pairs, self.targets.fraction

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b, mass, a in solved(batches):
                cells = b.column("cells")
                row = np.repeat(np.arange(b.num_rows), cells.value_lengths().to_numpy())
                flat = cells.flatten()
                where = [number[p] for p in zip(flat.field(0).to_pylist(), flat.field(1).to_pylist(), strict=True)]
                weight = a[row] * w[where] if len(where) else np.zeros(0)
                yield pa.RecordBatch.from_arrays([b.column("source").take(pa.array(row)), flat.field(0), flat.field(1), pa.array(weight / fraction), pa.array(np.minimum(1, weight))], names=[*MARGINALS, "weight", "probability"])

        number = {p: k for k, p in enumerate(pairs)}
        return shared.write_out(self.sources.mapInArrow(run, "source string, lang string, topic string, weight double, probability double"), "probabilities")


def cells_of(rows: DataFrame) -> DataFrame:
    return shared.write_out(rows.groupBy(*MARGINALS).agg(F.sum("n_tokens").cast("double").alias("mass")), "mass")


def report(probabilities: DataFrame, cells: DataFrame, targets: Targets | None = None) -> DataFrame:
    """(marginal, category, observed, target, achieved): shares of tokens; achieved is expected of the sample, of which
    a category that is taken whole may fall short of its target."""
    targets = targets or Targets()
    total = cells.agg(F.sum("mass")).first()[0] or 0.0
    both = cells.join(probabilities, list(MARGINALS)).withColumn("got", F.col("mass") * F.col("probability"))
    sampled = both.agg(F.sum("got")).first()[0] or 0.0
    out = None
    for m in MARGINALS:
        own = both.groupBy(F.col(m).alias("category")).agg(F.sum("mass").alias("mass"), F.sum("got").alias("got"))
        given = targets.shares.get(m, {})
        value = F.lit(None).cast("double")
        for k, v in given.items():
            value = F.when(F.col("category") == k, F.lit(float(v))).otherwise(value)
        own = own.withColumn("given", value).withColumn("flat", F.when(F.col("given").isNull(), F.pow(F.col("mass") / max(total, 1e-300), F.lit(targets.flatten.get(m, 1.0)))).otherwise(0.0))
        some = own.agg(F.sum("given"), F.sum("flat")).first()
        left = max(0.0, 1 - some[0]) if some[0] is not None else 1.0
        whole = max((some[0] or 0.0) + (left if some[1] else 0.0), 1e-300)
        target = F.coalesce("given", F.col("flat") * (left / max(some[1] or 0.0, 1e-300))) / whole
        part = own.select(F.lit(m).alias("marginal"), "category", (F.col("mass") / max(total, 1e-300)).alias("observed"), target.alias("target"), (F.col("got") / max(sampled, 1e-300)).alias("achieved"))
        out = part if out is None else out.unionByName(part)
    return out


def _fitted(docs: DataFrame, id_col: str, text_col: str, targets: Targets) -> tuple[DataFrame, Topics | None, DataFrame]:
    """Rows with cells, the topics found (none if the table has topics), and the cells' probabilities."""
    rows = described(docs, id_col, text_col)
    topics = None if "topic" in docs.columns else clusters(rows)
    rows = with_topics(rows, topics)
    return rows, topics, Raking(cells_of(rows), targets).probabilities()


def mix(docs: DataFrame, targets: Targets | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, source, lang, topic, n_tokens (words), weight, probability, kept.

    Null categories are the category "?"; null texts have no words: they weigh nothing, and are kept like others of
    their cell. Repeated ids share a decision within a cell, null ids too. An empty table gives an empty result. A table's
    own topic column counts; without one topics are clusters, t0, t1, ...
    """
    targets = targets or Targets()
    rows, _, found = _fitted(docs, id_col, text_col, targets)
    joined = rows.join(found, list(MARGINALS))
    return joined.select(F.col("id").alias(id_col), *MARGINALS, "n_tokens", "weight", "probability", taken(F.col("id"), targets.seed, F.col("probability")).alias("kept"))


def taken(key: Column, seed: int, probability: Column) -> Column:
    """Whether a row is in the sample: a hash of its key, as a number from 0 to 1, is below its probability."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 53)) < probability * float(1 << 53)


def sample(docs: DataFrame, targets: Targets | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that are taken, with docs' columns, whatever their names. Texts are read twice, and not shuffled
    where the cells' table is small enough for Spark to broadcast it."""
    targets = targets or Targets()
    _, topics, found = _fitted(docs, id_col, text_col, targets)
    own = [f"{shared.free_name(docs.columns)}{k}" for k in range(len(MARGINALS) + 1)]
    rows = docs.withColumn(own[0], category(docs, "source")).withColumn(own[1], category(docs, "lang"))
    if topics is None:
        rows = rows.withColumn(own[2], category(docs, "topic"))
    else:
        at = docs.columns.index(text_col)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(0, batch.num_rows, repeats.ROWS):
                    b = batch.slice(k, repeats.ROWS)
                    texts = pa.array([(t or "").encode("utf-8", "surrogatepass") for t in b.column(at).to_pylist()], pa.binary())
                    names = [f"t{x}" for x in topics.of(vectors(texts)[1], b.column(own[1]).to_pylist())]
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string())], names=[*b.schema.names, own[2]])

        rows = rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(own[2], StringType())]))
    found = found.select(*(F.col(m).alias(n) for m, n in zip((*MARGINALS, "probability"), own, strict=True)))
    return rows.join(found, own[:3]).where(taken(F.col(id_col), targets.seed, F.col(own[3]))).select(*docs.columns)


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(shared.table(spark, sf_dir, "documents"))
