"""Exact, near, byte and word dedup against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from nasty import corpus, docs

from lobspark.llm import exact_dedup, near_dedup, repeats, substring_dedup, suffix_dedup
from lobspark.llm.suffix_dedup import repeated_windows, suffix_array, suffix_arrays

SPACE, WORD = re.compile(r"[\x20\x09-\x0D]"), re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = corpus()


def test_exact(spark):
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(docs(spark, TEXTS), block_bytes=16).collect()}
    groups = defaultdict(list)
    for i, t in enumerate(TEXTS):
        groups[SPACE.sub("", t or "")].append(i)
    assert len(got) == len(TEXTS)
    for norm, ids in groups.items():
        best = min(ids, key=lambda i: (-len(TEXTS[i] or ""), i))
        for i in ids:
            r = got[i]
            assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (best, len(ids), i == best, hashlib.sha256(norm.encode()).hexdigest())


def test_exact_repeated_and_null_ids(spark):
    got = exact_dedup.exact_dedup(docs(spark, ["x y", "xy", "x y", "z", None], [7, None, 7, None, None])).collect()
    assert len(got) == 5 and sorted(r["group_size"] for r in got) == [1, 1, 3, 3, 3]
    assert sum(r["kept"] for r in got) == 3 and {r["keep_id"] for r in got if r["group_size"] == 3} == {7}
    kept = exact_dedup.keep_first(docs(spark, ["x y", "xy", "x y", "z", None], [7, None, 7, None, None]))
    assert kept.count() == 3 and kept.columns == docs(spark, []).columns


def test_exact_starts_again_when_digests_clash(spark, monkeypatch):
    from pyspark.sql import functions as F

    real, calls = F.xxhash64, []

    def weak(*cols):
        calls.append(cols)
        return real(F.lit(1)) if len(calls) <= 4 else real(*cols)

    monkeypatch.setattr(exact_dedup.F, "xxhash64", weak)
    got = exact_dedup.exact_dedup(docs(spark, ["a", "b", "a"])).collect()
    assert sorted(r["group_size"] for r in got) == [1, 2, 2]


def shingles(text):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(texts, ids, least=80):
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= least * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    smallest = {}
    for i in range(len(texts)):
        smallest[find(i)] = min(smallest.get(find(i), ids[i]), ids[i])
    return {ids[i]: (len(sets[i]), smallest[find(i)]) for i in range(len(texts))}


def near(spark, texts, **options):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs(spark, texts), **options).collect()}


def test_near(spark):
    assert near(spark, TEXTS) == brute_components(TEXTS, range(len(TEXTS)))


def chain(n, length=220, seed=4):
    """Copies of a text, each with a few words changed from the one before; and a hub with many spokes."""
    rnd = random.Random(seed)
    w = [f"w{rnd.randrange(10**6)}" for _ in range(length)]
    out = []
    for _ in range(n):
        out.append(" ".join(w))
        w = list(w)
        w[rnd.randrange(length)] = f"x{rnd.randrange(10**6)}"
    hub = [f"h{rnd.randrange(10**6)}" for _ in range(length)]
    for _ in range(n):
        spoke = list(hub)
        for k in (20, 90, 160):
            spoke[k + rnd.randrange(20)] = f"y{rnd.randrange(10**6)}"
        out.append(" ".join(spoke))
    return [*out, " ".join(hub)]


@pytest.mark.parametrize(("leaf", "wide"), [(256, 8), (8, 8), (8, 1)])
def test_near_large_groups_at_leaves_and_in_blocks(spark, monkeypatch, leaf, wide):
    monkeypatch.setattr(near_dedup, "WIDE", wide)
    texts = chain(60) + TEXTS[:20]
    assert near(spark, texts, leaf=leaf, block=16) == brute_components(texts, range(len(texts)))


def stage_corpus():
    """Texts and copies with words changed far apart; pairs from 0.80 to below 0.85, at 0.80 exactly, below it and above."""
    rnd, out = random.Random(12), []
    for n, changed in [(200, 4)] * 6 + [(220, 4)] * 3 + [(184, 4)] * 2 + [(200, 5)] * 3 + [(200, 3)] * 3:
        w = [f"v{rnd.randrange(10**7)}" for _ in range(n)]
        copy = list(w)
        for k in range(changed):
            copy[20 + 40 * k] = f"z{rnd.randrange(10**7)}"
        out += [" ".join(w), " ".join(copy)]
    return out


def brute_kept(texts, least):
    """The first of each component at a similarity of least hundredths, by exact integers."""
    sets, label = [shingles(t) for t in texts], list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if label[i] != label[j] and 100 * len(a & b) >= least * len(a | b) > 0:
                    label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    return set(label)


def test_near_stage_links_from_four_fifths(spark):
    import corpus_pipeline

    texts = stage_corpus()
    assert len(brute_kept(texts, 80)) < len(brute_kept(texts, 85)) < len(texts)  # pairs are planted between
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs(spark, texts), "").collect()} == brute_kept(texts, 80)
    assert {r["doc_id"] for r in near_dedup.near_duplicates(docs(spark, texts)).where("kept").collect()} == brute_kept(texts, 80)
    assert {r["doc_id"] for r in near_dedup.near_duplicates(docs(spark, texts), similar=(85, 100)).where("kept").collect()} == brute_kept(texts, 85)


def test_near_null_and_repeated_ids(spark):
    rows = near_dedup.near_duplicates(docs(spark, ["a b c d e f", "a b c d e f", "a b c d e f", None, "q"], [9, 9, None, None, 3])).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in rows) == [("3", "3", True), ("9", "9", True), ("9", "9", True), ("None", "9", False), ("None", "None", True)]
    kept = near_dedup.keep_one(docs(spark, ["a b c d e f", "a b c d e f", "a b c d e f", None, "q"], [9, 9, None, None, 3]))
    assert kept.count() == 3 and kept.columns == docs(spark, []).columns


def test_near_stage_keeps_unlinked_rows_of_an_id_and_one_of_null_ids(spark):
    w = [f"w{k}" for k in range(60)]
    a, b, c = " ".join(w), " ".join([*w[:-1], "end"]), " ".join(f"c{k}" for k in range(60))
    d, e = c + " more", "quite another text of seven words"
    kept = near_dedup.keep_one(docs(spark, [a, b, c, d, e, e + " x", "", ""], [None, None, 7, 9, 7, 4, 5, 5])).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept) == sorted([("None", next(r["text"] for r in kept if r["doc_id"] is None)), ("7", c), ("7", e), ("4", e + " x"), ("5", ""), ("5", "")])


@pytest.mark.parametrize("similar", [(80, 100), (85, 100), (1, 2), (99, 100), (1, 1)])
def test_sketches_miss_less_than_the_trees(similar):
    from math import comb

    s, n, cut = similar[0] / similar[1], near_dedup.SKETCH, near_dedup._cut(similar)
    assert sum(comb(n, k) * s**k * (1 - s) ** (n - k) for k in range(cut)) <= (1 - s) ** (near_dedup.BRANCH * near_dedup.TREES)
    sketch = [[1] * n, [1] * cut + [2] * (n - cut)]
    import numpy as np

    assert near_dedup._alike(np.array([9, 9]), np.array([9, 9]), np.array(sketch), np.array(sketch), similar).all()


def test_large_nodes_with_other_members_stay_apart(spark):
    from itertools import combinations

    hashes = [r[0] for r in spark.sql("select mod(xxhash64(id), 1000000007) from range(2000)").collect()]
    seen = {}
    for pair in combinations(range(2000), 2):  # two nodes that a sum of the hashes doesn't tell apart
        other = seen.setdefault(hashes[pair[0]] + hashes[pair[1]], pair)
        if other != pair:
            break
    large = spark.createDataFrame([(n, c) for n, x in ((1, other), (2, pair), (3, pair)) for c in x], "node long, class long")
    found = near_dedup._named(large).collect()
    assert other != pair and {(r["node"], r["class"]) for r in found} == {(n, c) for n, x in ((1, other), (2, pair)) for c in x}


@pytest.mark.parametrize("similar", [(85, 100), (80, 100), (1, 2)])
def test_dense_nodes_lose_no_component(spark, monkeypatch, similar):
    """One node of near copies of two texts, copies of copies and strangers: the components of all pairs."""
    import numpy as np

    monkeypatch.setattr(near_dedup, "WIDE", 1)
    rnd = random.Random(31)
    sets = []
    for base in (range(0, 100), range(60, 170)):
        for _ in range(45):
            x = set(base)
            for _ in range(rnd.choice([0, 2, 5, 9, 14])):
                x.discard(rnd.choice(list(base)))
                x.add(1000 + rnd.randrange(300))
            sets.append(x)
            if rnd.random() < 0.3:
                sets.append({*x, *(2000 + rnd.randrange(50) for _ in range(8))})
    sets += [{1, *(rnd.randrange(3000, 3400) for _ in range(60))} for _ in range(30)]
    sets = [sorted(x) for x in {tuple(sorted(x)) for x in sets}]
    root = list(range(len(sets)))

    def find(x, root):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len({*sets[i]} & {*sets[j]})
            if similar[1] * both >= similar[0] * (len(sets[i]) + len(sets[j]) - both):
                root[find(i, root)] = find(j, root)
    tokens = spark.createDataFrame([(k, *[bytearray(np.array(x, dtype=np.int64).tobytes())] * 2) for k, x in enumerate(sets)], "class long, tokens binary, seconds binary")
    large = spark.createDataFrame([(5, k) for k in range(len(sets))], "node long, class long")
    got = list(range(len(sets)))
    some, sure = near_dedup._dense_links(large, tokens, similar, 16)
    assert some and sure
    for links in some + sure:
        for r in links.collect():
            both = len({*sets[r["a"]]} & {*sets[r["b"]]})
            assert similar[1] * both >= similar[0] * (len(sets[r["a"]]) + len(sets[r["b"]]) - both)
            got[find(r["a"], got)] = find(r["b"], got)
    same = lambda root: {tuple(k for k in range(len(sets)) if find(k, root) == top) for top in {find(k, root) for k in range(len(sets))}}
    assert same(got) == same(root)


def test_near_broadcasts_by_counted_bytes(spark, monkeypatch):
    """Written tables are small as files, and explode() adds rows that no estimate has: what passes through the driver stays below the limit."""
    monkeypatch.setattr(near_dedup, "WIDE", 4)
    limit, rnd = 20_000, random.Random(8)
    w = [f"w{rnd.randrange(10**6)}" for _ in range(120)]
    texts = [" ".join(w[:k] + [f"x{rnd.randrange(10**6)}"] + w[k + 1 :]) for k in (rnd.randrange(120) for _ in range(500))]
    bus, store = spark.sparkContext._jsc.sc().listenerBus(), spark._jsparkSession.sharedState().statusStore()
    bus.waitUntilEmpty(30_000)
    began, before = store.executionsCount(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(limit))
    try:
        found = near_dedup.near_duplicates(docs(spark, texts), leaf=8, block=100)
        assert found.select("component_id").distinct().count() == len({c for _, c in brute_components(texts, range(len(texts))).values()})
        assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == str(limit)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    bus.waitUntilEmpty(30_000)
    rows, runs = [], store.executionsList()
    for e in (runs.apply(k).executionId() for k in range(began, runs.size())):
        nodes, values = store.planGraph(e).allNodes(), store.executionMetrics(e)
        for node in (nodes.apply(k) for k in range(nodes.size())):
            metrics = node.metrics()
            for m in (metrics.apply(k) for k in range(metrics.size() if node.name() == "BroadcastExchange" else 0)):
                if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    rows.append(int(values.apply(m.accumulatorId()).replace(",", "")))
    assert rows and max(rows) * 16 <= limit  # a row takes 16 bytes at least


def thue_morse(n, flip=False):
    """Words over two letters whose sums of values times powers are equal modulo 2 ** 64 for any odd base."""
    return "".join("ab"[(k.bit_count() + flip) % 2] for k in range(n))


@pytest.mark.parametrize("n", [1024, 2048, 8])
def test_words_that_collide_in_polynomial_hashes(spark, n):
    a, b = thue_morse(n), thue_morse(n, flip=True)
    texts = [a, b, f"one two three four five six seven {a}", f"one two three four five six seven {b}", " ".join([a] * 20), " ".join([a] * 13 + [b, a] * 20)]
    expected = brute_components(texts, range(len(texts)))
    assert near(spark, texts) == expected and len({c for _, c in expected.values()}) == 6
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.substring_dedup(docs(spark, texts)).collect()}
    assert got == brute_words(texts, range(len(texts)), 13) and got[5][1] == 13


def test_elements_decide_what_repeats_not_their_hashes():
    """With one hash for all words, periods are still seen on words."""
    import numpy as np

    texts = [" ".join(["x"] * 20), " ".join(["x"] * 13 + ["y", "x"] * 20), "p q r " * 30]
    words = lambda t: list(map(ord, "".join(t.split())))
    for t in texts:
        n = np.array([len(t.split())])
        g, _, first, many, _, times = repeats.runs(np.full(int(n[0]), 7, dtype=np.uint64), n, 13, 4, lambda _, t=t: np.array(words(t)))
        windows = [tuple(words(t)[k : k + 13]) for k in range(int(n[0]) - 12)]
        seen = [tuple(words(t)[k : k + 13]) for f, m in zip(first, many, strict=True) for k in range(f, f + m)]
        assert set(seen) == set(windows)  # collapsed runs lose no distinct window
        assert int((many * times).sum()) == len(windows)


def test_half_of_the_bits_may_be_equal_by_chance(spark, monkeypatch):
    """Where the first halves of all words' hashes are one, the second halves still tell what is linked."""
    import numpy as np

    hashes = substring_dedup.word_hashes

    def half(texts, lower=False, seed=0):
        found, sizes = hashes(texts, lower=lower, seed=seed)
        return (found if seed else found % np.uint64(3)), sizes

    monkeypatch.setattr(near_dedup, "word_hashes", half)
    texts = [f"alpha beta gamma delta w{k}" for k in range(12)] + ["alpha beta gamma delta w3", "x y z", "x y", "y x"]
    got = {}
    sets = near_dedup.shingle_sets(pa.array([t.encode() for t in texts]))
    for k, s in enumerate(sets):
        got[k] = [j for j, o in enumerate(sets) if near_dedup.in_common(s, o)]
    assert [k for k, v in got.items() if v != [k]] == [3, 12] and len({s[0].tobytes() for s in sets}) < 8


def test_shingles_that_share_half_of_their_bits():
    import numpy as np

    x, y, z = ([[1, 1, 2, 3], [5, 6, 7, 8]], [[1, 2, 3, 4], [6, 7, 9, 1]], [[1, 1, 2, 3], [5, 6, 7, 9]])
    sets = [np.array(s, dtype=np.uint64) for s in (x, y, z)]
    share = lambda a, b: len(set(zip(*a, strict=True)) & set(zip(*b, strict=True)))
    for a, p in zip((x, y, z), sets, strict=True):
        for b, q in zip((x, y, z), sets, strict=True):
            assert near_dedup.in_common(p, q) == share(a, b)


def brute_words(texts, ids, window):
    first, cut = {}, [WORD.findall(t or "") for t in texts]
    for i, w in zip(ids, cut, strict=True):
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, w in zip(ids, cut, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out[i] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest())
    return out


@pytest.mark.parametrize(("window", "group"), [(13, 5000), (3, 5000), (3, 1), (1, 5000)])
def test_words(spark, window, group):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.substring_dedup(docs(spark, TEXTS), window=window, group=group).collect()}
    assert got == brute_words(TEXTS, range(len(TEXTS)), window)


def brute_bytes(texts, window):
    cut = [(t or "").encode() for t in texts]
    count = Counter(b[k : k + window] for b in cut for k in range(len(b) - window + 1))
    out = {}
    for i, b in enumerate(cut):
        gone = bytearray(len(b))
        for k in range(len(b) - window + 1):
            if count[b[k : k + window]] > 1:
                gone[k : k + window] = b"\1" * window
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


@pytest.mark.parametrize(("window", "group"), [(200, 5000), (40, 5000), (40, 1), (9, 5000)])
def test_bytes(spark, window, group):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.suffix_dedup(docs(spark, TEXTS), window=window, group=group).collect()}
    assert got == brute_bytes(TEXTS, window)


def test_suffix_array_against_sorting():
    rnd = random.Random(2)
    for _ in range(400):
        t = [rnd.randrange(1, rnd.choice([2, 3, 9])) for _ in range(rnd.randrange(60))] + [0]
        assert suffix_array(t) == sorted(range(len(t)), key=lambda i: t[i:])


def test_suffix_arrays_in_step_against_one_by_one():
    import numpy as np

    rnd = random.Random(3)
    for many in (1, 31, 33, 120):
        texts = [[rnd.randrange(1, rnd.choice([2, 3, 9])) for _ in range(rnd.choice([3, 60, 60, 300]))] + [0] for _ in range(many)]
        sizes = np.array([len(t) for t in texts])
        got = suffix_arrays(np.array([x for t in texts for x in t]), sizes)
        for t, low in zip(texts, np.cumsum(sizes) - sizes, strict=True):
            assert (got[low : low + len(t)] - low).tolist() == suffix_array(t)


def test_repeated_windows():
    assert repeated_windows([[(b"abcabcd", 1), (b"xabcd", 1)], [(b"abc", 2), (b"q", 5)], [(b"abc", 1), (b"b", 1)]], 3) == [[(0, 4), (1, 2)], [(0, 0), (0, -1)], [(0, -1), (0, -1)]]
    rnd = random.Random(4)
    for window in (3, 8, 11):
        groups = [[(bytes(rnd.choices(b"ab", k=rnd.randrange(window, 40))), rnd.randrange(1, 3)) for _ in range(rnd.randrange(1, 4))] for _ in range(60)]
        groups = [list(dict(g).items()) for g in groups]
        for g, got in zip(groups, repeated_windows(groups, window), strict=True):
            count = Counter()
            for t, c in g:
                for k in range(len(t) - window + 1):
                    count[t[k : k + window]] += c
            hit = [[k for k in range(len(t) - window + 1) if count[t[k : k + window]] > 1] for t, _ in g]
            assert got == [(min(h), max(h)) if h else (0, -1) for h in hit]


def test_smallest_ids_of_words_against_brute_force():
    import numpy as np

    from lobspark.llm.substring_dedup import smallest_ids

    rnd, window, most = random.Random(5), 4, 2
    for _ in range(40):
        g, pieces, n, a, low = [], [], [], [], []
        for group in range(5):
            for _ in range(rnd.randrange(1, 5)):
                many = rnd.randrange(1, most + 2)
                at = rnd.randrange(many - 1, most + 1)
                pieces.append(" ".join(rnd.choices("ab", k=many + window - 1)).encode())
                g.append(group), n.append(many), a.append(at), low.append(rnd.randrange(9))
        got = smallest_ids(np.array(g), pieces, np.array(n), np.array(a), np.array(low), window, most)
        every = [(g[k], d, pieces[k].split()[a[k] - d : a[k] - d + window], k) for k in range(len(g)) for d in range(a[k] - n[k] + 1, a[k] + 1)]
        for group, d, w, k in every:
            assert got[k, d] == min(low[j] for h, e, v, j in every if (h, e, v) == (group, d, w))


def test_texts_longer_than_a_segment(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SEGMENT", 512)
    import numpy as np

    rnd = np.random.default_rng(1)
    text = rnd.integers(0, 4, 5000).astype(np.uint64)
    twice = np.r_[text, text]
    g, t, first, n, a, _ = repeats.runs(twice, np.array([5000, 5000]), 40, 8)
    cover = sorted((int(x), int(f) + k) for x, f, m in zip(t, first, n, strict=True) for k in range(m))
    assert set(cover) == {(x, k) for x in (0, 1) for k in range(4961)}  # every window has a run
    key = lambda x: {(int(f), int(m), int(h)) for y, f, m, h in zip(t, first, n, g, strict=True) if y == x}
    assert key(0) == key(1)


def test_each_window_of_a_long_text_has_one_run(monkeypatch):
    monkeypatch.setattr(repeats, "SEGMENT", 512)
    import numpy as np

    rnd = np.random.default_rng(1)
    for n in (511, 512, 513, 984, 985, 986, 5000):
        _, t, first, many, _, _ = repeats.runs(rnd.integers(0, 4, n).astype(np.uint64), np.array([n]), 40, 8)
        assert sorted(int(f) + k for f, m in zip(first, many, strict=True) for k in range(m)) == list(range(n - 39))


def test_bytes_of_a_text_longer_than_a_segment(spark):
    rnd = random.Random(6)
    text = "".join(rnd.choices("abcdefgh", k=repeats.SEGMENT + 3000))
    texts = [text, "x" + text[5000:5300] + "y", text[: repeats.SEGMENT - 150][-250:]]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.suffix_dedup(docs(spark, texts)).collect()}
    assert got == brute_bytes(texts, 200)
    alone = suffix_dedup.suffix_dedup(docs(spark, [text])).first()
    assert (alone["n_removed"], alone["n_spans"], alone["kept_sha256"]) == (0, 0, hashlib.sha256(text.encode()).hexdigest())


def test_runs_of_periodic_texts_are_collapsed():
    import numpy as np

    for period, n in ((1, 3000), (5, 3000), (60, 5000)):
        text = np.resize(np.random.default_rng(period).integers(0, 200, period), n).astype(np.uint64)
        _, _, first, many, _, times = repeats.runs(text, np.array([n]), 40, 8)
        assert (many * times).sum() == n - 39 and (period > 33 or len(first) <= 3)
        assert sorted(int(f) + k for f, m in zip(first, many * times, strict=True) for k in range(m)) == list(range(n - 39))


def test_periodic_and_long_texts(spark):
    rnd = random.Random(9)
    texts = ["a" * 3000, "ab" * 900, "xyz " * 700, "b" + "a" * 450 + "c", "".join(rnd.choices("abc", k=230)) * 3, "word " * 14, "one two " * 40, "z one two " * 9 + "one two " * 20]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.suffix_dedup(docs(spark, texts)).collect()}
    assert got == brute_bytes(texts, 200)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.substring_dedup(docs(spark, texts)).collect()}
    assert got == brute_words(texts, range(len(texts)), 13)


def test_one_byte_a_million_times(spark):
    r = suffix_dedup.suffix_dedup(docs(spark, ["a" * 20_000_000])).first()
    assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == (20_000_000, 20_000_000, 1)
    r = substring_dedup.substring_dedup(docs(spark, ["a " * 2_000_000, "q " + "a " * 1_000_000])).collect()
    assert sorted((x["doc_id"], x["n_words"], x["n_removed"]) for x in r) == [(0, 2_000_000, 0), (1, 1_000_001, 1_000_000)]


def test_a_passage_of_many_texts_is_split(spark):
    """More runs than a group takes at both ends of a passage that all texts hold, and near copies by the hundred."""
    rnd = random.Random(10)
    word = lambda: f"w{rnd.randrange(10**6)}"
    passage, base = [word() for _ in range(60)], [word() for _ in range(150)]
    texts = [" ".join([*[word() for _ in range(30)], *passage, *[word() for _ in range(30)]]) for _ in range(60)]
    for _ in range(60):
        copy = list(base)
        copy[rnd.randrange(150)] = word()
        texts.append(" ".join(copy))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.suffix_dedup(docs(spark, texts), group=8).collect()}
    assert got == brute_bytes(texts, 200)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.substring_dedup(docs(spark, texts), group=8).collect()}
    assert got == brute_words(texts, range(len(texts)), 13)


def test_ids_of_other_types(spark):
    texts, names = TEXTS[:40], [f"d{(7 * k) % 40:02d}" for k in range(40)]
    frame = spark.createDataFrame([(n, t, "s", 1) for n, t in zip(names, texts, strict=True)], "doc_id string, text string, id string, row int")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.substring_dedup(frame, window=5).collect()}
    assert got == brute_words(texts, names, 5)
    texts = chain(6) + TEXTS[:27]
    frame = spark.createDataFrame(list(zip(names, texts, strict=True)), "doc_id string, text string")
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(frame, similar=(85, 100)).collect()} == brute_components(texts, names)
    assert {r["doc_id"]: r["n_removed"] for r in suffix_dedup.suffix_dedup(frame, window=40).collect()} == {n: v[1] for n, v in zip(names, brute_bytes(texts, 40).values(), strict=True)}


def test_empty_tables(spark):
    none = docs(spark, [])
    for run in (exact_dedup.exact_dedup, near_dedup.near_duplicates, substring_dedup.substring_dedup, suffix_dedup.suffix_dedup, exact_dedup.keep_first, near_dedup.keep_one):
        assert run(none).count() == 0
