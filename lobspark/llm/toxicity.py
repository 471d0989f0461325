"""Toxicity by a convolutional text classifier that is trained here, in numpy.

A word's vector is the sum of hashed embeddings of the word and of its beginnings and end, so that unseen inflections
share what was learnt. Filters of several widths slide over the whole text; the highest response of each filter, anywhere
in the text, goes through a rectifier into a logistic output. As filters are linear in the vectors, each word type's
responses are computed once, and a text costs only sums of looked-up rows.

Training begins on the driver with a bounded first part of the labelled rows (TRAIN_ROWS and TRAIN_WORDS, parameters of fit()), chosen
by a hash of the id. If there are more, all of them go on with it: each task takes a pass over its rows from the same network, and
the changes are averaged, a bucket's vector over the rows of tasks that have met it. A part of the rows (all that are set
aside, not a sample of them) calibrates the score and gives each language a threshold of its own. A score depends on the text alone.

Scale: scoring is one pass without shuffle. The model is a few megabytes, whatever the input.
"""

from __future__ import annotations

import copy
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import shared

#: Bounds of the labelled rows that are learnt from, and of the words in all of them.
TRAIN_ROWS, TRAIN_WORDS = 8_000, 8_000_000
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 16, 8, 8, (1, 2, 3)
BATCHES, STEPS, RATE = (32, 256), 360, 0.15
THRESHOLD = 0.3
WORD = re.compile(r"\w+")
KEPT = 200_000
#: Words that filters slide over at once.
PIECE = 500_000
SPAN = sum(WIDTHS)


def word_pieces(word: str) -> list[int]:
    """Buckets of a word's parts: the word, its beginnings of three to eight characters, its last three."""
    parts = ["=" + word, "-" + word[-3:], *("+" + word[:k] for k in range(3, min(8, len(word)) + 1))]
    return [zlib.crc32(p.encode("utf-8", "surrogatepass")) % BUCKETS for p in parts]


class Network:
    def __init__(self, seed: int = 7) -> None:
        rnd = np.random.default_rng(seed)
        self.table = rnd.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
        self.filters = rnd.normal(0, 0.5, (SPAN, DIM, FILTERS)).astype(np.float32)
        self.bias = np.zeros(len(WIDTHS) * FILTERS, dtype=np.float32)
        self.out = rnd.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
        self.out_bias, self.scale, self.shift = np.float32(-2), 1.0, 0.0

    def vectors(self, pieces: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.table[pieces], starts, axis=0) if len(starts) else np.zeros((0, DIM), dtype=np.float32)

    def responses(self, vectors: np.ndarray) -> np.ndarray:
        """A row for each word type: its part in each filter at each of its places."""
        return (vectors @ self.filters.transpose(1, 0, 2).reshape(DIM, -1)).astype(np.float32)

    def slide(self, rows: np.ndarray, types: np.ndarray) -> np.ndarray:
        """Responses at each word; texts are parted by the empty type 0, so no filter meets two texts."""
        n, out, k = len(types), [], 0
        for width in WIDTHS:
            got = np.zeros((n, FILTERS), dtype=np.float32)
            for j in range(width):
                got[: n - j] += rows[:, k * FILTERS : (k + 1) * FILTERS][types[j:]]
                k += 1
            out.append(got)
        return np.hstack(out)

    def peaks(self, rows: np.ndarray, types: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in each text each filter responds most, and how much; long texts go through in pieces."""
        ends = np.r_[starts[1:], len(types)] - TAIL
        if len(types) <= PIECE:
            got = self.slide(rows, types)
            where = np.vstack([a + got[a:b].argmax(axis=0) for a, b in zip(starts, ends, strict=True)])
            return where, np.take_along_axis(got, where, axis=0)
        where, most = np.zeros((len(starts), len(self.bias)), dtype=np.int64), np.full((len(starts), len(self.bias)), -np.inf, dtype=np.float32)
        for i, (a, b) in enumerate(zip(starts, ends, strict=True)):
            for k in range(a, b, PIECE):
                n = min(PIECE, b - k)
                got = self.slide(rows, types[k : k + n + TAIL])[:n]
                at = got.argmax(axis=0)
                top = np.take_along_axis(got, at[None], axis=0)[0]
                where[i], most[i] = np.where(top > most[i], k + at, where[i]), np.maximum(top, most[i])
        return where, most

    def logits(self, rows: np.ndarray, types: np.ndarray, starts: np.ndarray) -> np.ndarray:
        ends = np.r_[starts[1:], len(types)] - TAIL
        if len(types) > PIECE:
            return np.maximum(self.peaks(rows, types, starts)[1] + self.bias, 0) @ self.out + self.out_bias
        pooled = np.maximum(np.maximum.reduceat(self.slide(rows, types), np.column_stack([starts, ends]).ravel(), axis=0)[::2] + self.bias, 0)
        return pooled @ self.out + self.out_bias

    def scores(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.scale * logits.astype(float) + self.shift)))


#: Empty types after each text: filters that begin on a word or in the first half end in the second, never in the next text.
TAIL = max(WIDTHS) - 1
GAP = [0] * (2 * TAIL)


class Numbered:
    """Texts as type numbers from 1, each with a gap at its end, and the pieces of all types, in arrays only."""

    def __init__(self, texts: Iterable[list[str]]) -> None:
        number: dict[str, int] = {}
        self.rows = [np.array([number.setdefault(w, len(number) + 1) for w in x] + GAP, dtype=np.int32) for x in texts]
        pieces, sizes = array("H"), array("B")
        for w in number:
            own = word_pieces(w)
            pieces.extend(own)
            sizes.append(len(own))
        self.pieces, self.size = np.array(pieces, dtype=np.int32), np.array(sizes, dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size

    def batch(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For some texts: their words as numbers of the types they have, the texts' starts; the types' pieces, starts and sizes."""
        own, types = np.unique(np.concatenate([self.rows[i] for i in which]), return_inverse=True)  # 0, the gap, stays first
        lengths = np.array([len(self.rows[i]) for i in which])
        size = self.size[own[1:] - 1]
        begin = np.cumsum(size) - size
        parts = self.pieces[np.repeat(self.start[own[1:] - 1] - begin, size) + np.arange(size.sum())]
        return types, np.cumsum(lengths) - lengths, parts, begin, size


def _logits(net: Network, texts: Numbered, which: np.ndarray) -> np.ndarray:
    out = [np.zeros(0)]
    for k in range(0, len(which), 64):
        types, starts, parts, begin, _ = texts.batch(which[k : k + 64])
        out.append(net.logits(net.responses(np.vstack([np.zeros((1, DIM), dtype=np.float32), net.vectors(parts, begin)])), types, starts))
    return np.concatenate(out)


def _sums(net: Network) -> dict[str, np.ndarray]:
    """Squares of gradients that steps are divided by, as they begin."""
    return {k: np.full(getattr(net, k).shape, 1e-3, dtype=np.float32) for k in ("table", "filters", "bias", "out")} | {"out_bias": np.array([1e-3])}


def _learn(net: Network, sums: dict[str, np.ndarray], texts: Numbered, labels: np.ndarray, batches: Iterable[np.ndarray]) -> None:
    """A pass of gradient steps, one a batch of texts."""

    def step(name: str, at, grad: np.ndarray) -> None:
        sums[name][at] += grad * grad
        getattr(net, name)[at] -= RATE * grad / np.sqrt(sums[name][at])

    for batch in batches:
        types, at, parts, begin, many = texts.batch(batch)
        vec = np.vstack([np.zeros((1, DIM), dtype=np.float32), net.vectors(parts, begin)])
        where, peak = net.peaks(net.responses(vec), types, at)
        peak = peak + net.bias
        pooled = np.maximum(peak, 0)
        guess = 1 / (1 + np.exp(-(pooled @ net.out + net.out_bias)))
        err = ((guess - labels[batch]) / len(batch)).astype(np.float32)
        back = err[:, None] * net.out * (peak > 0)
        step("out", slice(None), pooled.T @ err)
        sums["out_bias"][0] += float(err.sum()) ** 2
        net.out_bias -= np.float32(RATE * err.sum() / np.sqrt(sums["out_bias"][0]))
        step("bias", slice(None), back.sum(axis=0))
        grad_vec, grad_filters, j0 = np.zeros_like(vec), np.zeros_like(net.filters), 0
        for b, width in enumerate(WIDTHS):
            f = slice(b * FILTERS, (b + 1) * FILTERS)
            for j in range(width):
                there = types[where[:, f] + j]
                for c in range(FILTERS):
                    np.add.at(grad_vec, there[:, c], back[:, f][:, c, None] * net.filters[j0, :, c])
                    grad_filters[j0, :, c] += back[:, f][:, c] @ vec[there[:, c]]
                j0 += 1
        step("filters", slice(None), grad_filters)
        hit = np.flatnonzero(np.any(grad_vec[1:], axis=1))
        spread = np.concatenate([parts[begin[h] : begin[h] + many[h]] for h in hit]) if len(hit) else np.zeros(0, dtype=np.int64)
        touched, back_at = np.unique(spread, return_inverse=True)
        grad = np.zeros((len(touched), DIM), dtype=np.float32)
        np.add.at(grad, back_at, np.repeat(grad_vec[1:][hit], many[hit], axis=0))
        step("table", touched, grad)


def train(texts: Iterable[list[str]], labels: np.ndarray, langs: list[str | None], seed: int = 7) -> tuple[Network, dict[str | None, float]]:
    """A network and each language's threshold, from tokenised texts and their labels."""
    net, rnd = Network(seed), np.random.default_rng(seed)
    if not len(labels) or labels.min() == labels.max():
        net.out[:] = 0
        net.out_bias = np.float32(np.log((labels.sum() + 0.5) / (len(labels) - labels.sum() + 0.5)))
        return net, {}
    texts = Numbered(texts)
    aside = rnd.random(len(labels)) < 0.15
    learn = np.flatnonzero(~aside)
    sums = _sums(net)
    size = int(np.clip(len(learn) / 40, *BATCHES))  # small sets take smaller batches, and as many steps
    for _ in range(max(6, STEPS * size // max(1, len(learn)))):
        order = rnd.permutation(learn)
        _learn(net, sums, texts, labels, (order[k : k + size] for k in range(0, len(order), size)))
    net.sums = sums
    rest = np.flatnonzero(aside) if 0 < labels[aside].sum() < aside.sum() else np.arange(len(labels))
    logit = _logits(net, texts, rest)
    _calibrate(net, logit, labels[rest])
    score = net.scores(logit)
    lang = np.array([x or "" for x in langs])[rest]
    return net, {str(x): _threshold(score[lang == x], labels[rest][lang == x]) for x in sorted(set(lang))}


def _calibrate(net: Network, logit: np.ndarray, label: np.ndarray, many: np.ndarray | float = 1.0) -> None:
    """Fits scale and shift of the logits by Newton steps on the rows set aside (many of each), with targets a little off 0 and 1."""
    pos, neg = (many * label).sum(), (many * (1 - label)).sum()
    target = np.where(label == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * logit + b, -30, 30)))
        g = np.array([(many * (p - target) * logit).sum() + 1e-2 * (a - 1), (many * (p - target)).sum()])
        w = many * (p * (1 - p) + 1e-6)
        h = np.array([[(w * logit * logit).sum() + 1e-2, (w * logit).sum()], [(w * logit).sum(), w.sum()]])
        d = np.linalg.solve(h + 1e-6 * np.eye(2), g)
        a, b = max(1e-2, a - np.clip(d[0], -1, 1)), b - np.clip(d[1], -1, 1)
    net.scale, net.shift = float(a), float(b)


def _threshold(score: np.ndarray, label: np.ndarray, many: np.ndarray | None = None) -> float:
    """The score with the best F1 over the rows (many of each); the plain threshold where a language has no row of either label."""
    if not 0 < label.sum() < len(label):
        return THRESHOLD
    order = np.argsort(-score, kind="stable")
    many = np.ones(len(label)) if many is None else many
    hits = np.cumsum((many * label)[order])
    k = int((2 * hits / (np.cumsum(many[order]) + hits[-1])).argmax())
    return float((score[order][k] + (score[order][k + 1] if k + 1 < len(order) else 0)) / 2)


class Scorer:
    """Scores whole texts; keeps the responses of word types it has met."""

    def __init__(self, net: Network) -> None:
        self.net = net
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {"": 0}
        self.rows = np.zeros((KEPT + 1, SPAN * FILTERS), dtype=np.float32)

    def score(self, texts: list[str]) -> np.ndarray:
        words = [WORD.findall(t.lower()) for t in texts]
        new = list(set().union(*words).difference(self.number))
        if len(self.number) + len(new) > KEPT:
            self.clear()
            new = list(set().union(*words))
        if len(new) >= KEPT:  # more types than the table holds: text by text
            return np.concatenate([self.score([t]) for t in texts]) if len(texts) > 1 else self._alone(words[0])
        pieces = [word_pieces(w) for w in new]
        size = np.array([len(p) for p in pieces], dtype=np.int64)
        first = len(self.number)
        if new:
            self.rows[first : first + len(new)] = self.net.responses(self.net.vectors(np.array([p for x in pieces for p in x], dtype=np.int64), np.cumsum(size) - size))
        self.number.update(zip(new, range(first, first + len(new)), strict=True))
        types, starts, n = [], [], 0
        for x in words:
            starts.append(n)
            types += map(self.number.__getitem__, x)
            types += GAP
            n = len(types)
        return self.net.scores(self.net.logits(self.rows, np.array(types, dtype=np.int64), np.array(starts)))

    def _alone(self, words: list[str]) -> np.ndarray:
        return self.net.scores(_logits(self.net, Numbered([words]), np.array([0])))


#: Rows and words that a task holds at once when all rows are learnt from, or one longer text.
TASK_ROWS, TASK_WORDS = 2_000, 200_000
#: Steps to one in a sum of changes, so that sums don't depend on their order; steps to one in counted logits, and their bound.
EXACT, LOGIT_STEPS, LOGIT_MOST = 1 << 24, 100, 30
NAMES = ("table", "filters", "bias", "out")


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Numbered, list[int], list[str | None], list[np.ndarray]]]:
    """Rows as numbered texts, labels, languages, and batches of bounded numbers of words, in the order of id hashes."""
    rows: list[tuple[int, int, str | None, list[str]]] = []
    total = 0

    def made():
        rows.sort(key=lambda x: x[0])
        cuts, at, n = [], [], 0
        for k, x in enumerate(rows):
            if at and (len(at) == BATCHES[1] or n + len(x[3]) > TASK_WORDS // 2):
                cuts.append(np.array(at))
                at, n = [], 0
            at.append(k)
            n += len(x[3])
        return Numbered(x[3] for x in rows), [x[1] for x in rows], [x[2] for x in rows], [*cuts, np.array(at)]

    for b in batches:
        for turn, label, lang, words in zip(*(b.column(c) for c in ("turn", "label", "lang", "words")), strict=True):
            cut = words.as_py().split()
            if rows and (len(rows) == TASK_ROWS or total + len(cut) > 10 * TASK_WORDS):
                yield made()
                rows, total = [], 0
            rows.append((turn.as_py(), label.as_py(), lang.as_py(), cut))
            total += len(cut)
    if rows:
        yield made()


def _pass_over_all(net: Network, rows: DataFrame) -> None:
    """Each task learns from its rows, all from one network; the changes are added up by Spark and averaged."""
    sent = rows.sparkSession.sparkContext.broadcast(net)  # a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n = copy.deepcopy(sent.value), 0
        for texts, labels, _, cuts in _held(batches):
            _learn(own, own.sums, texts, np.array(labels, dtype=np.float32), cuts)
            n += len(labels)
        if n:
            change = [getattr(own, k).astype(float) - getattr(sent.value, k) for k in NAMES]
            met = np.any(change[0], axis=1) * n
            flat = np.concatenate([np.rint(np.concatenate([*(x.ravel() for x in change), [float(own.out_bias) - float(sent.value.out_bias)]]) * n * EXACT).astype(np.int64), met, [n]])
            yield pa.RecordBatch.from_arrays([pa.array([flat.astype(np.int64).tobytes()], pa.binary())], names=["change"])

    total = rows.mapInArrow(run, "change binary").rdd.map(lambda r: np.frombuffer(r[0], dtype=np.int64)).treeReduce(np.add)
    met, n, at = np.maximum(total[-1 - BUCKETS : -1], 1), int(total[-1]), 0
    for k in NAMES:
        old = getattr(net, k)
        change = total[at : at + old.size].reshape(old.shape) / EXACT
        setattr(net, k, (old + change / (met[:, None] if k == "table" else n)).astype(np.float32))
        at += old.size
    net.out_bias = np.float32(net.out_bias + total[at] / EXACT / n)


def _settle(net: Network, rows: DataFrame) -> dict[str, float]:
    """Calibrates on all rows that were set aside, and gives languages their thresholds, from counts of logits in steps of a hundredth."""
    sent = rows.sparkSession.sparkContext.broadcast(net)  # a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, labels, langs, cuts in _held(batches):
            logit = np.concatenate([_logits(sent.value, texts, c) for c in cuts])
            step = np.rint(np.clip(logit, -LOGIT_MOST, LOGIT_MOST) * LOGIT_STEPS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([x or "" for x in langs], pa.string()), pa.array(labels, pa.int32()), pa.array(step, pa.int32())], names=["lang", "label", "step"])

    got = rows.mapInArrow(run, "lang string, label int, step int").groupBy("lang", "label", "step").count().toPandas().sort_values(["lang", "label", "step"])
    logit, label, many, lang = got["step"].to_numpy() / LOGIT_STEPS, got["label"].to_numpy(dtype=float), got["count"].to_numpy(dtype=float), got["lang"].to_numpy()
    if not 0 < label.sum() < len(label):
        return {}
    _calibrate(net, logit, label, many)
    score = net.scores(logit)
    return {str(x): _threshold(score[lang == x], label[lang == x], many[lang == x]) for x in sorted(set(lang))}


def held_out(id_col: str) -> Column:
    """Rows whose label must not be learnt from: crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic", train_rows: int = TRAIN_ROWS, train_words: int = TRAIN_WORDS) -> tuple[Network, dict]:
    """Trains on all labelled rows outside the held-out part: on the driver in the order of their id hashes until a bound is met,
    then, if that wasn't all, in a pass of all tasks over all of them.

    train_rows bounds the ids, train_words the words of the first part; both bound the driver's memory, whatever the tables' sizes.
    The first row that would go beyond train_words ends the first part, long or short; only a single text of more than an
    eighth of train_words is left to the pass. Of several documents with one id the smallest text counts; of several labels 1.
    Null ids and labels other than 0 and 1 teach nothing.
    """
    ids = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    ids = ids.withColumn("turn", F.xxhash64("id"))
    chosen = ids.orderBy("turn", "id").limit(train_rows)  # a bounded number of rows: safe to broadcast
    lang = F.col(lang_col) if lang_col in docs.columns else F.lit(None)
    slim = docs.select(F.col(id_col).alias("id"), shared.text_or_empty(text_col).alias("text"), lang.cast("string").alias("lang"))
    once = lambda rows: rows.groupBy("id", "label", "turn").agg(F.min(F.struct("text", "lang")).alias("doc")).select("id", "label", "turn", "doc.*")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(b.num_rows):
                part = b.slice(at, 1)
                cut = WORD.findall(part.column("text")[0].as_py().lower())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("id", "lang", "label", "turn")), pa.array([" ".join(cut)], pa.string()), pa.array([len(cut)], pa.int64())], names=["id", "lang", "label", "turn", "words", "n"])

    kind = docs.schema[id_col].dataType.simpleString()
    cut = lambda rows, name: shared.write_out(rows.mapInArrow(words, f"id {kind}, lang string, label int, turn bigint, words string, n bigint"), name)
    first = cut(once(slim.join(F.broadcast(chosen), "id")), "labelled")
    known = first.where(F.col("n") <= train_words // 8)
    upto = F.sum("n").over(Window.orderBy("turn", "id"))  # of train_rows narrow rows at most
    within = known.select("id", "turn", "n").withColumn("upto", upto).where(F.col("upto") <= train_words).select("id")
    known = known.join(F.broadcast(within), "id")
    got = known.select("id", "lang", "label", "words").toPandas().sort_values("id")
    net, thresholds = train((x.split() for x in got["words"]), got["label"].to_numpy(dtype=np.float32), got["lang"].to_list())
    if ids.count() > train_rows or first.count() > len(got):
        thresholds = _with_all(net, cut(once(slim.join(ids, "id")), "labelled-all"), within) or thresholds
    net.__dict__.pop("sums", None)
    return net, thresholds


def _with_all(net: Network, rows: DataFrame, within: DataFrame) -> dict[str, float]:
    """Goes on with a network over all rows, but for those that are set aside: about 15 of 100 that weren't in the first part."""
    if rows.select("label").distinct().count() < 2:
        return {}
    if not hasattr(net, "sums"):  # one label only in the first part
        net.__dict__.update(Network().__dict__)
        net.sums = _sums(net)
    net.scale, net.shift = 1.0, 0.0
    known = rows.join(F.broadcast(within.withColumn("met", F.lit(True))), "id", "left")
    aside = F.col("met").isNull() & (F.pmod(F.xxhash64(F.lit("aside"), "id"), F.lit(100)) < 15)
    _pass_over_all(net, known.where(~aside))
    rest = known.where(aside)
    return _settle(net, rest if rest.select("label").distinct().count() == 2 else known)


def scored(docs: DataFrame, net: Network, text_col: str, out: str) -> DataFrame:
    """docs with one more column, out, which docs mustn't have: the score of each row's text; null texts count as empty."""
    at = docs.columns.index(text_col)
    sent = docs.sparkSession.sparkContext.broadcast(net)  # a fixed size: the network's arrays

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                part = batch.slice(k, 200)
                texts = [t or "" for t in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scorer.score(texts), pa.float64())], names=[*part.schema.names, out])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(out, DoubleType())]))


def score(docs: DataFrame, net: Network, thresholds: dict | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row: id, held_out, score, predicted (score >= 0.3), flagged (score >= the threshold of the row's language).

    Null texts count as empty and get the score of no words. Null ids are never held out. Other columns aren't read.
    """
    lang = F.col(lang_col) if lang_col in docs.columns else F.lit(None)
    slim = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.coalesce(lang.cast("string"), F.lit("")).alias("lang"), F.col(text_col).alias("text"))
    own = F.lit(THRESHOLD)
    for x, t in sorted((thresholds or {}).items()):
        own = F.when(F.col("lang") == x, F.lit(float(t))).otherwise(own)
    found = scored(slim, net, "text", "score")
    return found.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), (F.col("score") >= own).alias("flagged"))


def reject(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score stays below the threshold, with docs' columns, whatever their names. The network is trained on these docs."""
    net, _ = fit(docs, labels, id_col, text_col)
    own = shared.free_name(docs.columns)
    return scored(docs, net, text_col, own).where(F.col(own) < threshold).select(*docs.columns)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    return score(docs, *fit(docs, shared.table(spark, sf_dir, "labels")))
