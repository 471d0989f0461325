"""Near-duplicate documents by a chosen-path set similarity join.

A document is its set of distinct shingles of five words. Documents with equal sets form a class from the start. Classes go
down independent trees: at a node every class selects the BRANCH tokens of its set with the smallest hashes (of that tree
and level) and goes to one child for each. Children of one class end. Nodes of at most LEAF classes are compared
exhaustively; larger ones branch again. What is still large at the last level, or doesn't get smaller by branching (many
near copies of one text), is compared with its consensus, which leaves smaller nodes without a loss. A pair with similarity s misses one level of
a tree with a chance of at most (1 - s) ** BRANCH, and must miss a level in every tree to be lost by the trees: with three
trees and three tokens, for leaves of the first, second and third level, at most 5.1e-7, 4.1e-6 and 1.4e-5 at 0.8, and
3.8e-8, 3.1e-7 and 1.0e-6 at 0.85.

Exhaustive comparison of a leaf is on 64-byte minwise sketches and set sizes; it passes pairs that might reach the
similarity, and these are confirmed on full sets. A shingle is 128 bits of hashes without algebraic structure: trees,
sketches and first comparisons look at half of them, whatever becomes a class or a link is confirmed on all. All trees share the sketches, so their chance of a miss is added: the cut
is as high as keeps it below that of the trees' first level (3.2e-7 at 0.8, 3.5e-8 at 0.85). Together a link of just the
least similarity in leaves of the first level is lost with a chance of at most 8.4e-7 at 0.8 and 7.3e-8 at 0.85. Components are found by the smallest
label over links with pointer jumping, in written tables.

Scale: nodes are counted before anything else is shipped; children of one class, nearly all, stop there. Classes keep exact
copies out of the trees. No group is collected beyond a leaf or a block.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, LongType, StructField, StructType

from . import repeats, shared
from .substring_dedup import word_hashes

SHINGLE = 5
#: What pairs are linked from, where no contract says otherwise, as an exact fraction.
SIMILAR = (80, 100)
TREES, LEVELS, BRANCH, LEAF, BLOCK = 3, 3, 3, 256, 512
#: Blocks of a node that are compared with each other, so that no set is sent out more often.
WIDE = 8
SKETCH = 64
#: A node that keeps this share of its classes together in a child isn't split by branching.
DENSE = 0.5
#: Parts of a node whose classes are confirmed against one class.
SALTS = 32
#: Bytes of sets that go to Python at once.
AT_ONCE = 1 << 23
_MULTIPLIERS = np.random.default_rng(2024).integers(1, 1 << 62, TREES * LEVELS + SKETCH, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(tokens: np.ndarray, k: int) -> np.ndarray:
    x = tokens * _MULTIPLIERS[k]
    return x ^ x >> np.uint64(32)


def shingle_sets(texts: pa.Array, shingle: int = SHINGLE) -> list[np.ndarray]:
    """For each text (bytes, A-Z lowered): its distinct shingles in order, the whole text if it has fewer words, as two rows
    of hashes; a shingle is what stands in both rows at one place."""
    grams, whole = [], []
    for seed in (0, 1):
        hashes, sizes = word_hashes(texts, lower=True, seed=seed)
        grams.append(repeats.gram_hashes(hashes, shingle))
        whole.append(hashes)
    at = np.cumsum(sizes) - sizes

    def one(a: int, n: int) -> np.ndarray:
        if n < shingle:
            return np.stack([repeats.gram_hashes(h[a : a + n], n) + np.uint64(n) if n else h[:0] for h in whole])
        first, second = (g[a : a + n - shingle + 1] for g in grams)
        order = np.argsort(first)
        x, y = first[order], second[order]
        new, other = x[1:] != x[:-1], y[1:] != y[:-1]
        if (other & ~new).any():  # two shingles share the first half
            order = np.lexsort((second, first))
            x, y = first[order], second[order]
            new = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        keep = np.r_[True, new]
        return np.stack([x[keep], y[keep]])

    return [one(a, n) for a, n in zip(at.tolist(), sizes.tolist(), strict=True)]


def in_common(p: np.ndarray, q: np.ndarray) -> int:
    """How many shingles two sets share."""
    both = np.concatenate([p, q], axis=1)
    order = np.argsort(both[0], kind="stable")
    x, y = both[:, order]
    same, also = x[1:] == x[:-1], y[1:] == y[:-1]
    if (same & ~also).any():  # different shingles share the first half
        return len(set(zip(*p.tolist(), strict=True)) & set(zip(*q.tolist(), strict=True)))
    return int(same.sum())


def _confirmed(pairs: DataFrame, similar: tuple[int, int], rows: int = 2) -> DataFrame:
    """(a, b) of those rows of (a, b, x, y) whose sets x and y, of so many rows of hashes, reach the similarity."""

    def common(p: np.ndarray, q: np.ndarray) -> int:
        return in_common(p, q) if rows == 2 else len(np.intersect1d(p[0], q[0], assume_unique=True))

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                b, ok = whole.slice(at, 200), []
                for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True):
                    p, q = (np.frombuffer(t, dtype=np.uint64).reshape(rows, -1) for t in (x, y))
                    shared_ = common(p, q)
                    ok.append(similar[1] * shared_ >= similar[0] * (p.shape[1] + q.shape[1] - shared_))
                yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.select("a", "b", "x", "y").mapInArrow(confirm, "a bigint, b bigint")


def described(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sketches (SKETCH bytes a set) and selected tokens (TREES x LEVELS x BRANCH a set, ragged sets repeat their last)."""
    sizes = np.array([len(s) for s in sets])
    sketch, picks = np.zeros((len(sets), SKETCH), dtype=np.uint8), np.zeros((len(sets), TREES * LEVELS, BRANCH), dtype=np.int64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return sketch, picks
    tokens = np.concatenate([sets[i] for i in full])
    at = np.cumsum(sizes[full]) - sizes[full]
    for k in range(SKETCH):
        low = np.minimum.reduceat(_mixed(tokens, TREES * LEVELS + k), at)
        sketch[full, k] = (low * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(56)).astype(np.uint8)
    ends = np.r_[at[1:], len(tokens)]
    for k in range(TREES * LEVELS):
        h = _mixed(tokens, k)
        for j in range(BRANCH):  # the smallest, then the smallest above it, ...
            low = np.minimum.reduceat(h, at)
            picks[full, k, j] = low.view(np.int64)
            if j + 1 < BRANCH:
                h = np.where(h == np.repeat(low, ends - at), np.uint64(0xFFFFFFFFFFFFFFFF), h)
    top = np.int64(-1)
    for j in range(1, BRANCH):
        picks[:, :, j] = np.where(picks[:, :, j] == top, picks[:, :, j - 1], picks[:, :, j])
    return sketch, picks


def _cut(similar: tuple[int, int]) -> int:
    """The most agreements of sketches to ask for, so that fewer are less likely at the similarity than a miss of the trees."""
    s, below = similar[0] / similar[1], 0.0
    for k in range(SKETCH):
        below += comb(SKETCH, k) * s**k * (1 - s) ** (SKETCH - k)
        if below > (1 - s) ** (BRANCH * TREES):
            return k
    return SKETCH


def _alike(n: np.ndarray, m: np.ndarray, a: np.ndarray, b: np.ndarray, similar: tuple[int, int]) -> np.ndarray:
    """Which pairs of rows of (sizes, sketches) might reach the similarity."""
    least = _cut(similar)
    out = np.minimum(n[:, None], m) * similar[1] >= similar[0] * np.maximum(n[:, None], m)
    for i in range(0, len(n), 64):
        out[i : i + 64] &= (a[i : i + 64, None, :] == b[None, :, :]).sum(axis=2) >= least
    return out


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, SKETCH)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similar: tuple[int, int] = SIMILAR, leaf: int = LEAF, block: int = BLOCK, row_col: str | None = None) -> DataFrame:
    """Per row: id, n_shingles, component_id (smallest id linked, itself included), kept (id is component_id).

    Two rows are linked when intersection / union of their sets is at least similar[0] / similar[1]. Null texts and texts
    without words have empty sets, linked with nothing. Null ids come after all others: they are component_id only where
    a component has no other. Ids may be of any type that sorts. Repeated rows are linked like any equal sets. Other columns aren't read. With row_col, a unique number
    of each row, the result has it too, as row, with the component's own number and the id's order (component, ord).
    """
    with shared.counted_sizes(docs.sparkSession):
        texts = repeats.base(docs, id_col, text_col, row_col)
        sets, least = _linked(texts, shingle, similar, leaf, block)
        ids = texts.schema["id"].dataType
        if not isinstance(ids, IntegralType):
            named = shared.write_out(texts.where("id IS NOT NULL").groupBy(F.col("ord").alias("first")).agg(F.first("id").alias("least_id")), "names")
    # the caller runs these joins: tables of classes and rows go through exchanges there, too
    names = texts.select("row", "id").hint("merge")
    out = sets.select("row", "ord", "n", "f1", "f2").join(least.hint("merge"), ["f1", "f2"], "left").join(names, "row")
    first = F.coalesce(F.when(F.col("n") > 0, F.col("first")), F.col("ord"))
    out = out.withColumn("first", first)
    if isinstance(ids, IntegralType):
        component = F.when(F.col("first") < F.lit(repeats.LAST), F.col("first")).cast(ids)
    else:  # the order's number back to its id
        out, component = out.join(named.hint("merge"), "first", "left"), F.col("least_id")
    numbers = ["row", F.when(F.col("n") > 0, F.col("label")).otherwise(F.col("row")).alias("component"), "ord"] if row_col else []
    return out.select(*numbers, F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def _linked(texts: DataFrame, shingle: int, similar: tuple[int, int], leaf: int, block: int) -> tuple[DataFrame, DataFrame]:
    """The rows' sets (size, digest, sketch and picks), and of each digest the component's label and smallest ord."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in repeats._batches(batches):
            sets = shingle_sets(b.column(2), shingle)
            sketch, picks = described([s[0] for s in sets])
            digests = np.frombuffer(b"".join(xxhash.xxh128_digest(s.tobytes()) for s in sets), dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([s.shape[1] for s in sets], pa.int64()), pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array([s.tobytes() for s in sketch], pa.binary()), pa.array(picks.reshape(len(sets), -1).tolist(), pa.list_(pa.int64()))], names=["row", "ord", "n", "f1", "f2", "sketch", "picks"])

    sets = shared.write_out(texts.select("row", "ord", "text").mapInArrow(describe, "row bigint, ord bigint, n bigint, f1 bigint, f2 bigint, sketch binary, picks array<bigint>"), "sets")
    classes = shared.write_out(sets.where("n > 0").groupBy("f1", "f2").agg(F.min("row").alias("class"), F.min("ord").alias("least")), "classes")
    mark = shared.written()
    leaders = shared.write_out(sets.join(classes.select(F.col("class").alias("row")), "row").select(F.col("row").alias("class"), "n", "sketch", "picks"), "leaders")

    pairs, large = _candidates(leaders, similar, leaf)
    wanted = pairs.select(F.col("a").alias("class")).union(pairs.select("b"))
    if large is not None:
        wanted = wanted.union(large.select("class"))

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in repeats._batches(batches):
            sets = shingle_sets(b.column(1), shingle)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([s[i].tobytes() for s in sets], pa.binary()) for i in (0, 1))], names=["class", "tokens", "seconds"])

    tokens = texts.join(wanted.distinct().withColumnRenamed("class", "row").hint("merge"), "row").select("row", "text").mapInArrow(full, "class bigint, tokens binary, seconds binary")
    tokens = shared.write_out(tokens, "tokens")

    side = lambda name, column, of: tokens.select(F.col("class").alias(name), of.alias(column))
    joined = lambda pairs, of: pairs.join(side("a", "x", of), "a").join(side("b", "y", of), "b")
    near = _confirmed(joined(pairs, F.col("tokens")), similar, rows=1)
    some, sure = _dense_links(large, tokens, similar, block) if large is not None else ([], [])
    for more in some:
        near = near.unionByName(more)
    links = _confirmed(joined(shared.write_out(near, "near", AT_ONCE), both()), similar)
    for more in sure:
        links = links.unionByName(more)
    links = shared.write_out(links, "links", AT_ONCE)
    shared.drop_since(mark, links)
    labels = components(links)
    shared.drop_since(mark, labels)
    least = classes.join(labels, "class", "left").withColumn("label", F.coalesce("label", "class"))
    least = least.join(least.groupBy("label").agg(F.min("least").alias("first")), "label").select("f1", "f2", "first", "label")
    least = shared.write_out(least, "least")
    shared.drop(classes, labels)
    return sets, least


def _candidates(leaders: DataFrame, similar: tuple[int, int], leaf: int) -> tuple[DataFrame, DataFrame | None]:
    """Pairs of classes that may be similar, from all leaves; and the members of nodes that stay large."""
    spark = leaders.sparkSession
    pick = lambda tree, level: F.slice("picks", (tree * LEVELS + level) * BRANCH + 1, BRANCH)
    trees = F.explode(F.flatten(F.array(*[F.transform(pick(t, 0), lambda x, t=t: F.struct(F.lit(t).alias("tree"), F.xxhash64(F.lit(t), x).alias("node"))) for t in range(TREES)])))
    rows = leaders.select("class", trees.alias("to")).select("class", "to.*").distinct()
    small, large = None, None
    for level in range(LEVELS):
        rows = shared.write_out(rows, f"paths{level}")
        nodes = rows.groupBy("node").agg(F.count("*").alias("many")).where("many > 1")
        nodes = shared.write_out(nodes, f"nodes{level}")
        ends = rows.join(nodes.where(F.col("many") <= leaf).select("node"), "node").select("node", "class")
        small = ends if small is None else small.unionByName(ends)
        over = nodes.where(F.col("many") > leaf)
        if over.isEmpty():
            break
        rows = rows.join(over.select("node", "many"), "node")
        if level + 1 < LEVELS:
            chosen = F.lit(None)
            for t in range(TREES):
                chosen = F.when(F.col("tree") == t, pick(t, level + 1)).otherwise(chosen)
            rows = rows.join(leaders.select("class", "picks"), "class").select("class", "tree", F.col("node").alias("parent"), "many", F.explode(F.array_distinct(chosen)).alias("token"))
            rows = shared.write_out(rows.withColumn("node", F.xxhash64("parent", "token")).drop("token"), f"children{level}")
            dense = rows.groupBy("parent", "node", "many").agg(F.count("*").alias("kept")).where(F.col("kept") > DENSE * F.col("many")).select("parent").distinct()
            dense = shared.write_out(dense, f"dense{level}")
            hard = rows.join(dense, "parent").select(F.col("parent").alias("node"), "class").distinct()
            rows = rows.join(dense, "parent", "left_anti").select("class", "tree", "node")
        else:
            hard = rows.select("node", "class")
        large = hard if large is None else large.unionByName(hard)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(b: pa.RecordBatch) -> pa.RecordBatch:
            node, cls, n = (b.column(i).to_numpy() for i in range(3))
            sketch, a, z = _sketches(b.column(3)), [], []
            first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
            for s, e in zip(first, np.r_[first[1:], len(node)], strict=True):
                i, j = np.nonzero(np.triu(_alike(n[s:e], n[s:e], sketch[s:e], sketch[s:e], similar), 1))
                a.append(np.minimum(cls[s + i], cls[s + j]))
                z.append(np.maximum(cls[s + i], cls[s + j]))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, z)], names=["a", "b"])

        held = None
        for b in batches:
            b = b if held is None else pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            node = b.column(0).to_numpy()
            k = int(np.searchsorted(node, node[-1])) if len(node) else 0  # the last node may go on in the next batch
            if k:
                yield found(b.slice(0, k))
            held = b.slice(k)
        if held is not None and held.num_rows:
            yield found(held)

    seen = small.join(leaders.select("class", "n", "sketch"), "class").select("node", "class", "n", "sketch")
    pairs = seen.repartition(shared.many_parts(spark), "node").sortWithinPartitions("node", "class").mapInArrow(compare, "a bigint, b bigint").distinct()
    pairs = shared.write_out(pairs, "candidates")
    return pairs, None if large is None else shared.write_out(large, "dense")


def both() -> Column:
    """All bits of a set's shingles."""
    return F.concat("tokens", "seconds")


def _sets(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(t, dtype=np.int64) for t in column.to_pylist()]


def _exploded(frame: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """A row for each token of the sets in a column, with the columns of keep."""
    schema = frame.select(*keep).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                sets = _sets(part.column(column))
                rows = pa.array(np.repeat(np.arange(len(sets)), [len(x) for x in sets]))
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(rows) for c in keep), pa.array(np.concatenate(sets) if sets else np.zeros(0, dtype=np.int64))], names=[*keep, "token"])

    return frame.select(*keep, column).mapInArrow(run, StructType([*schema.fields, StructField("token", LongType())]))


def _named(large: DataFrame) -> DataFrame:
    """(node, class, many) of nodes with more than one member; nodes with equal members (by 128 bits) are one."""
    nodes = large.groupBy("node").agg(F.count("*").alias("many"), F.bit_xor(F.xxhash64("class")).alias("x1"), F.bit_xor(F.xxhash64(F.lit(17), "class")).alias("x2"))
    nodes = nodes.groupBy("many", "x1", "x2").agg(F.min("node").alias("node")).where("many > 1")
    return shared.write_out(large.join(nodes.select("node", "many"), "node"), "members")


def _dense_links(large: DataFrame, tokens: DataFrame, similar: tuple[int, int], block: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Links that join the same classes as all links within large nodes do: by half of the shingles' bits, and by all.

    A node of at most WIDE blocks of classes is compared exhaustively, each pair of blocks a task. A larger one is compared with its consensus C, the tokens
    that more than half of its classes have. With D(x), the tokens that only one of x and C has, and
    e(x) = (q + p) |D(x)| - (q - p) |x|, classes x and y have a similarity of p / q or more if and only if
    e(x) + e(y) <= 2 (q + p) |D(x) & D(y)|. So the class m with the least e is linked to all with e(x) + e(m) <= 0, and
    these need no comparison with each other: whatever pairs of them are linked are in m's component. Each other class
    must share tokens of D with those it is linked to, so many that one is among its rarest |D| - o + 1, where o is the
    least that e(x) + e(m) allows. These tokens are the next nodes. A token is in D for at most half of a node's classes, so
    nodes halve with each round and no round's end compares a large one in full. Near copies of one text are so done in a
    time that grows with their number, not with its square.
    """
    p, q = similar
    links: list[DataFrame] = []
    sure: list[DataFrame] = []
    slim = tokens.select("class", "tokens")
    while True:
        members = _named(large)
        small = _blocks(members.where(F.col("many") <= block * WIDE), block)
        links.append(small.join(slim, "class").groupBy("node", "i", "j").applyInPandas(lambda f: _forest(f, similar), "a bigint, b bigint"))
        big = members.where(F.col("many") > block * WIDE)
        if big.isEmpty():
            return links, sure
        counts = _exploded(big.join(slim, "class"), "tokens", ["node", "many"]).groupBy("node", "many", "token").agg(F.count("*").alias("n"))
        counts = shared.write_out(counts, "counts", AT_ONCE)
        consensus = counts.where(F.col("n") * 2 > F.col("many")).groupBy("node").agg(F.collect_list("token").alias("consensus"))  # at most twice a mean set

        def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                own = [np.setxor1d(x, np.array(c or (), dtype=np.int64), assume_unique=True) for x, c in zip(_sets(b.column("tokens")), b.column("consensus").to_pylist(), strict=True)]
                size = [len(t) // 8 for t in b.column("tokens").to_pylist()]
                e = [(q + p) * len(d) - (q - p) * n for d, n in zip(own, size, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("node"), b.column("class"), b.column("many"), pa.array(e, pa.int64()), pa.array([len(d) for d in own], pa.int64()), pa.array([d.tobytes() for d in own], pa.binary())], names=["node", "class", "many", "e", "size", "own"])

        apart = big.join(slim, "class").join(consensus, "node", "left").select("node", "class", "many", "tokens", "consensus").mapInArrow(compared, "node bigint, class bigint, many bigint, e bigint, size bigint, own binary")
        apart = shared.write_out(apart, "apart", AT_ONCE)
        middle = shared.write_out(apart.groupBy("node").agg(F.min(F.struct("e", "class")).alias("m")).select("node", F.col("m.e").alias("least"), F.col("m.class").alias("middle")), "middle")
        seen = apart.join(middle, "node").withColumn("over", F.col("e") + F.col("least"))
        near = seen.where("over <= 0 AND class <> middle").select("node", "class", F.pmod(F.xxhash64("class"), F.lit(SALTS)).alias("salt")).join(tokens.select("class", both().alias("y")), "class")
        center = middle.join(tokens.select(F.col("class").alias("middle"), both().alias("x")), "middle").withColumn("salt", F.explode(F.array(*[F.lit(i).cast("long") for i in range(SALTS)])))
        sure.append(_confirmed(near.join(center, ["node", "salt"]).select(F.col("middle").alias("a"), F.col("class").alias("b"), "x", "y"), similar))
        rest = shared.write_out(seen.where("over > 0"), "rest")
        if rest.isEmpty():
            return links, sure
        # a token of C in D is one that the class lacks
        rarity = F.when(F.col("n") * 2 > F.col("many"), F.col("many") - F.col("n")).otherwise(F.col("n"))
        heads = _exploded(rest, "own", ["node", "class", "size", "over"]).join(counts.select("node", "token", rarity.alias("rarity")), ["node", "token"])
        rank = F.row_number().over(Window.partitionBy("node", "class").orderBy("rarity", "token"))  # of one set
        needed = F.greatest(F.lit(1), F.ceil(F.col("over") / (2 * (q + p))))
        heads = heads.withColumn("rank", rank).where(F.col("rank") <= F.col("size") - needed + 1).select("node", "token").distinct()
        large = _exploded(apart, "own", ["node", "class"]).join(heads, ["node", "token"]).select(F.xxhash64("node", "token").alias("node"), "class")
        large = shared.write_out(large, "narrower", AT_ONCE)


def _blocks(members: DataFrame, block: int) -> DataFrame:
    """(node, i, j, class): the classes of each pair of blocks of each node."""
    each = members.withColumn("blocks", F.ceil(F.col("many") / block).cast("int"))
    each = each.withColumn("k", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return each.select("node", "class", "k", other.alias("o")).select("node", F.least("k", "o").alias("i"), F.greatest("k", "o").alias("j"), "class")


def _forest(f, similar: tuple[int, int]):
    """A spanning forest of the links within some classes, from exact intersections of full sets."""
    import pandas as pd

    sets = [np.frombuffer(t, dtype=np.uint64) for t in f["tokens"]]
    size = np.array([len(s) for s in sets])
    code = np.unique(np.concatenate(sets), return_inverse=True)[1]
    owner = np.repeat(np.arange(len(sets)), size)
    useful = np.bincount(code)[code] > 1
    code, owner = np.unique(code[useful], return_inverse=True)[1], owner[useful]
    common = np.zeros((len(sets), len(sets)), dtype=np.float32)
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    for low in range(0, int(code.max(initial=-1)) + 1, 4096):
        a, z = np.searchsorted(code, [low, low + 4096])
        part = np.zeros((len(sets), 4096), dtype=np.float32)
        part[owner[a:z], code[a:z] - low] = 1
        common += part @ part.T
    linked = np.triu(similar[1] * common >= similar[0] * (size[:, None] + size - common), 1)
    root = list(range(len(sets)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for x, y in zip(*np.nonzero(linked), strict=True):
        first, second = find(x), find(y)
        if first != second:
            root[second] = first
            out.append((x, y))
    cls = f["class"].to_numpy()
    return pd.DataFrame({"a": [int(cls[x]) for x, _ in out], "b": [int(cls[y]) for _, y in out]}, dtype="int64")


def components(links: DataFrame) -> DataFrame:
    """(class, label) for all ends of links: the smallest class that can be reached."""
    edges = shared.write_out(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = shared.write_out(edges.select(F.col("a").alias("class")).distinct().withColumn("label", F.col("class")), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("class", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near.withColumnRenamed("a", "class"), "class").select("class", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        step = shared.write_out(step, "step")
        jump = step.select(F.col("class").alias("label"), F.col("label").alias("far"))
        new = shared.write_out(step.join(jump, "label").select("class", F.least("label", "far").alias("label"), "old"), "labels")
        if new.where("label <> old").isEmpty():
            labels = new.select("class", "label")
            labels._lobspark_path = new._lobspark_path
            return labels
        shared.drop(labels, step)
        labels = new.drop("old")
        labels._lobspark_path = new._lobspark_path


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with docs' columns, whatever their names: of each component the one with the smallest
    id (null ids last), then row."""
    own = shared.free_name(docs.columns)
    numbered = shared.write_out(docs.withColumn(own, F.monotonically_increasing_id()), "rows")
    found = near_duplicates(numbered, id_col, text_col, row_col=own)
    stay = found.groupBy("component").agg(F.min(F.struct("ord", "row")).alias("first")).select(F.col("first.row").alias(own))
    return numbered.join(stay, own).select(*docs.columns)


def op1_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(shared.table(spark, sf_dir, "documents"), similar=(85, 100))


SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(words[p:p + 4], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS p FROM w WHERE len(words) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), c AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * common >= 85 * (p.n + q.n - common)
), r AS (
  SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.other
), m AS (
  SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id
)
SELECT m.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id, m.doc_id = m.component_id AS kept FROM m LEFT JOIN n USING (doc_id)
"""
