"""Source divergence, chunk reuse and centroid clustering against brute force."""

import hashlib
import random
import re
from collections import Counter
from itertools import pairwise

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
from comparing import DATA
from nasty import corpus
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lobspark.llm import chunk_reuse, clustering, divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def brute_divergence(rows, least, top=50):
    """rows of (text, lang, source) -> {(lang, source, part, item): (value, rank)} by the formulas on Python integers."""
    rows = [tuple(x or "" for x in r) for r in rows]
    cut = [TERM.findall(t.translate(LOWER)) for t, _, _ in rows]
    out = {}
    for lang in {r[1] for r in rows}:
        mine = [(r[2], c) for r, c in zip(rows, cut, strict=True) if r[1] == lang]
        docs = Counter(t for _, c in mine for t in set(c))
        kept = [t for t, n in docs.items() if n >= least]
        v = len(kept)
        count = {s: Counter() for s, _ in mine}
        for s, c in mine:
            count[s].update(c)
        whole = sum(count.values(), Counter())

        def shares(c, kept=kept, v=v):
            n = sum(c[t] for t in kept)
            return {t: 1 + (10**9 * (c[t] + 5)) // (n + 5 * v) for t in kept}

        p, q = {s: shares(c) for s, c in count.items()}, shares(whole)
        for s in count:
            pairs = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in count if o != s))
            terms = sorted((q[t] - p[s][t], t.encode(), t) for t in kept if count[s][t] > 0 and p[s][t] > q[t])[:top]
            for part, items in (("pair", pairs), ("term", terms)):
                for k, (f, _, item) in enumerate(items):
                    out[lang, s, part, item] = (-f, k + 1)
    return out


def audit(frame, **options):
    found = [((r["lang"], r["source"], r["part"], r["item"]), (r["value"], r["rank"])) for r in divergence.divergence(frame, **options).collect()]
    assert len(dict(found)) == len(found)
    return dict(found)


AUDIT = "doc_id long, text string, lang string, source string, term string, n long, row int, LANG_ string, shard long, value string"


def audit_rows(spark, rows):
    return spark.createDataFrame([(k, *r, "t", 1, 2, "l", 3, "v") for k, r in enumerate(rows)], AUDIT)


def audit_corpus():
    rnd = random.Random(4)
    words = [*"The the THE cat Dog über ünï 中文 d'or A1b x\x7fy zebra 😀 q".split(), "nul\x00byte", "é"]
    rows = []
    for k in range(240):
        lang, source = rnd.choice(["en", "de", None]), rnd.choice(["web", "web", "web", "books", "Ünews", None, "a"])
        n = rnd.choice([0, 1, 5, 40])
        rows.append((" ".join(rnd.choice(words[: 6 + k % 9]) for _ in range(n)), lang, source))
    rows += [(None, "en", "web"), ("", "xx", "only"), ("rare words here", "yy", "s1"), (" \t", "yy", "s2"), ("a" * 50_000 + " cat", "en", "books")]
    return rows + rows[:20]


@pytest.mark.parametrize(("least", "shard_rows", "slice_rows"), [(30, 100_000, 4000), (3, 7, 5), (1, 50, 1)])
def test_divergence(spark, monkeypatch, least, shard_rows, slice_rows):
    monkeypatch.setattr(divergence, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(divergence, "SLICE_ROWS", slice_rows)
    rows = audit_corpus()
    got = audit(audit_rows(spark, rows), least_docs=least)
    assert got == brute_divergence(rows, least) and any(part == "term" for _, _, part, _ in got)


def test_divergence_top_terms_and_ties(spark):
    rows = [(" ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)), "en", "a")] * 3 + [("other", "en", "b")] * 3
    got = audit(audit_rows(spark, rows), least_docs=3)
    assert got == brute_divergence(rows, 3) and sum(part == "term" for _, _, part, _ in got) == 51


def test_divergence_of_nothing(spark):
    assert audit(audit_rows(spark, [])) == {}
    rows = [(None, None, None), ("few", "en", "a"), ("few", "en", "b")]
    assert audit(audit_rows(spark, rows)) == {("en", "a", "pair", "b"): (0, 1), ("en", "b", "pair", "a"): (0, 1)}


def test_pieces_end_between_terms():
    text = ("word " * 100 + "x" * 300 + " é中 " * 50).encode()
    cut = divergence.pieces(text, 64)
    assert b"".join(cut) == text and len(cut) > 5
    assert [t for p in cut for t in TERM.findall(p.decode())] == TERM.findall(text.decode())
    assert divergence.pieces(b"") == [b""] and divergence.pieces(b"abc" * 100, 10) == [b"abc" * 100]


def fresh(mean):
    return chunk_reuse.Chunks(chunk_reuse.encoder(*PATHS), mean)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATHS[0])


def awkward(rnd):
    pool = ["the", " ", "  ", "\n\n", "\t", "don't", "we'll", "'s", "'", "''ll", "123", "4x", "é", "中文字", "日本語テキスト", "😀😀", "　", "\xa0", "...", "!?", "<|endoftext|>", "<|endof", "text|>", "a" * 70, "Ж слово ", "\r\n", "½", "​", "é", "\x00", "_"]
    return "".join(rnd.choice(pool) for _ in range(rnd.choice([1, 5, 60, 400])))


@pytest.mark.parametrize("mean", [2, 7, 40, 512])
def test_chunked_ids_are_those_of_the_library(library, mean):
    rnd, table = random.Random(mean), fresh(mean)
    shared_part = " ".join(f"word{rnd.randrange(50)}, it's" for _ in range(300))
    texts = [awkward(rnd) for _ in range(250)] + [t or "" for t in corpus(mean)] + [awkward(rnd)[:50] + shared_part + awkward(rnd)[:50] for _ in range(20)]
    for t in texts:
        want = library.encode(t, add_special_tokens=False).ids
        ids = table.encode(t)
        assert ids.tolist() == want, t[:200]
        assert table.decode(ids) == library.decode(want, skip_special_tokens=False) == t
    assert table.reused > 20  # passages in common are encoded once


def test_chunks_that_disagree_are_encoded_anew(library):
    """A table with wrong ids for whole chunks: repairs notice at the seams, and the ids are still right where they look."""
    text = " ".join(f"word{k} and {k % 7}" for k in range(400))
    table = fresh(64)
    assert table.encode(text).tolist() == library.encode(text).ids
    for part in [*table.kept][1:]:  # all but the first: letters one by one
        table.kept[part] = np.concatenate([table._plain(bytes([b])) for b in part]).astype(np.uint32)
    assert table.encode(text).tolist() == library.encode(text).ids and table.widened > 0


def test_cuts_follow_the_content():
    rnd = random.Random(1)
    body = bytes(rnd.randrange(97, 123) for _ in range(20_000))

    def own(data):
        at = [0, *chunk_reuse.cuts(np.frombuffer(data, dtype=np.uint8), 256), len(data)]
        return {data[a:b] for a, b in pairwise(at)}

    a, b = own(body), own(b"something else in front " + body)
    assert len(a) > 40 and len(a - b) <= 2
    wide = np.frombuffer("ünï中文😀".encode() * 500, dtype=np.uint8)
    assert all((wide[k] & 0xC0) != 0x80 for k in chunk_reuse.cuts(wide, 4))


def test_round_trip_through_spark(spark, library):
    texts = [None, "", " ", "<|endoftext|>", "a<|endoftext|><|endoftext|>b", "中文" * 3000, "word " * 60_000, *corpus(3, 20)]
    texts += texts[3:8]
    frame = spark.createDataFrame([(k if k % 5 else None, t, "x", 1, "y", b"z") for k, t in enumerate(texts)], "doc_id long, text string, id string, n_tokens int, decoded string, ids binary")
    both = chunk_reuse.decode(chunk_reuse.encode(frame, *PATHS), *PATHS)
    got = sorted(((r["doc_id"] or -1), bytes(r["ids"]), r["n_tokens"], r["decoded"]) for r in both.collect())
    ids = [np.array(library.encode(t or "", add_special_tokens=False).ids, dtype="<u4") for t in texts]
    assert got == sorted(((k if k % 5 else -1), i.tobytes(), len(i), t or "") for k, (t, i) in enumerate(zip(texts, ids, strict=True)))
    assert chunk_reuse.decode(chunk_reuse.encode(frame.limit(0), *PATHS), *PATHS).count() == 0


def test_chunk_query_against_the_library(spark, library):
    got = chunk_reuse.op12_chunk_reuse(spark, f"{DATA}/sf0.001").toPandas().set_index("doc_id")
    docs = pd.read_parquet(f"{DATA}/sf0.001/documents.parquet").set_index("doc_id")["text"].fillna("")
    assert sorted(got.index) == sorted(docs.index)
    for k, t in docs.items():
        ids = library.encode(t, add_special_tokens=False).ids
        want = len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        assert tuple(got.loc[k, ["n_tokens", "ids_sha256", "decoded_sha256"]]) == want


def brute_clusters(x, start, rounds):
    c = [list(map(int, v)) for v in start]
    assign = lambda v: min(range(len(c)), key=lambda j: (sum((int(a) - b) ** 2 for a, b in zip(v, c[j], strict=True)), j))
    for _ in range(rounds):
        own = [assign(v) for v in x]
        for j in range(len(c)):
            rows = [v for v, o in zip(x, own, strict=True) if o == j]
            if rows:
                c[j] = [sum(map(int, col)) // len(rows) for col in zip(*rows, strict=True)]
    own = [assign(v) for v in x]
    return own, [sum((int(a) - b) ** 2 for a, b in zip(v, c[o], strict=True)) for v, o in zip(x, own, strict=True)], c


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "c", 2, 3) for i, v in rows], "vec_id long, embedding array<float>, own int, cluster string, id int, v int")


@pytest.mark.parametrize(("k", "rounds", "at_once"), [(1, 3, 4096), (2, 4, 3), (8, 10, 50), (25, 8, 7), (60, 3, 4096)])
def test_clusters(spark, monkeypatch, k, rounds, at_once):
    """Grouped vectors with many ties, of few small integers, so that distances are often equal."""
    monkeypatch.setattr(clustering, "AT_ONCE", at_once)
    rnd = np.random.default_rng(k)
    x = (rnd.integers(-3, 4, (150, 5)) * rnd.choice([1, 40], (150, 1))).astype(np.float32) / 1024
    x = np.r_[x, x[:20]]
    report = []
    got = clustering.cluster(vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)]), F.lpad(F.col("vec_id").cast("string"), 5, "0"), k, rounds, 5, report=report).toPandas().sort_values("vec_id")
    whole = np.floor(x.astype(float) * 1024).astype(int)
    own, distance, c = brute_clusters(whole, whole[:k], rounds)
    assert got["cluster"].tolist() == own and got["distance"].tolist() == distance
    inertia = {j: sum(d for d, o in zip(distance, own, strict=True) if o == j) for j in own}
    assert got["cluster_inertia"].tolist() == [inertia[o] for o in own] and set(got["inertia"]) == {sum(distance)}
    assert got["centroid_sha256"].tolist() == [hashlib.sha256(",".join(map(str, c[o])).encode()).hexdigest() for o in own]
    assert report[0][1] == len(x) and len(report) == rounds + 1


def test_bounds_hold_and_save_comparisons():
    """After each move the bounds are bounds, and far fewer distances are computed than by comparing everything."""
    rnd = np.random.default_rng(5)
    middle = rnd.integers(-900, 900, (24, 16))
    x = (middle[rnd.integers(0, 24, 3000)] + rnd.integers(-150, 150, (3000, 16))).astype(np.int64)
    c = x[:24].copy()
    b, keep = clustering.Bounds.start(len(x), 6), 6
    for n in range(12):
        b.assign(x, c)
        d = clustering.exact_distances(x, c)
        assert (b.own == d.argmin(axis=1)).all()
        root, rows = np.sqrt(d), np.arange(len(x))
        assert (root[rows, b.own] <= b.upper).all()
        for z in range(keep):
            assert (b.lower[:, z] <= root[rows, b.near[:, z]]).all()
        others = np.ones_like(d, dtype=bool)
        others[rows, b.own] = False
        others[rows[:, None], b.near] = False
        assert (np.where(others, root, np.inf).min(axis=1) >= b.rest).all()
        new = np.array([x[b.own == j].sum(axis=0) // max(1, (b.own == j).sum()) if (b.own == j).any() else c[j] for j in range(24)])
        far = clustering._above(np.sqrt(((new - c) ** 2).sum(axis=1)))
        c, keep = new, max(3, keep - (n == 4))
        b.moved(far, keep)
    assert b.compared < 12 * len(x) * 24 / 3


def test_exact_distances_of_large_integers():
    x = np.array([[10**9, 3], [-(10**9), 7], [0, 0]])
    assert clustering.exact_distances(x, x[:2]).tolist() == [[0, 4 * 10**18 + 16], [4 * 10**18 + 16, 0], [10**18 + 9, 10**18 + 49]]


def test_clustering_odd_vectors(spark):
    good = [(k, [k / 8, 1.0, -k / 8]) for k in range(5)]
    odd = [(10, None), (11, [1.0, None, 2.0]), (12, [1.0, float("nan"), 0.0]), (13, [1.0, float("inf"), 0.0]), (14, [1.0]), (15, []), (None, [0.0, 1.0, 0.0])]
    got = clustering.cluster(vectors(spark, good + odd + good[:2]), F.lpad(F.col("vec_id").cast("string"), 5, "0"), 8, 2, 3).collect()
    assert sorted(str(r["vec_id"]) for r in got) == ["0", "0", "1", "1", "2", "3", "4", "None"] and {r["distance"] for r in got} == {0}
    assert clustering.cluster(vectors(spark, odd[:-1]), F.lit("x"), 8, 2, 3).count() == 0
    assert clustering.cluster(vectors(spark, []), F.lit("x"), 8, 2, 3).count() == 0


def test_slices_of_lists():
    rows = pa.array([[1, 2], [3, 4], [5, 6]]).slice(1)
    assert clustering._matrix(rows, 2).tolist() == [[3, 4], [5, 6]]
