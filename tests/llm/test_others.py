"""Token counts, packing, toxicity, extraction, mixing and search against libraries and brute force."""

import html
import re
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from nasty import corpus, docs

from lobspark.llm import html_text, knn_join, mixing, packing, token_counts, toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")
DATA = "/root/testdata"
TEXTS = corpus() + ["x<|endoftext|>y", "</s><unk>", "▁ ▁▁", "\x00\x01​ "]
BPE, RANKS, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"))


def test_counts_equal_the_library(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = {r["doc_id"]: r for r in token_counts.token_counts(docs(spark, TEXTS), PIECES, limit=100).collect()}
    for i, t in enumerate(TEXTS):
        n = len(model.encode(t or ""))
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((t or "").encode()), n, n > 100)
    assert token_counts.token_counts(docs(spark, []), PIECES).count() == 0


def test_counts_when_the_kept_table_is_full(monkeypatch):
    import sentencepiece

    monkeypatch.setattr(token_counts, "KEPT", 10)
    texts = [t or "" for t in TEXTS[:30]]
    counter = token_counts.Counter(PIECES)
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert [counter.count([t])[0] for t in texts] == [len(x) for x in model.encode(texts)]


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(BPE)
    got = packing.pack(docs(spark, TEXTS), BPE, RANKS, max_tokens=64).toPandas()
    for i, t in enumerate(TEXTS):
        ids = np.array([*model.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        own = got[got.doc_id == i].sort_values("piece")
        assert own["piece"].tolist() == list(range(len(own))) and own["length"].sum() == len(ids)
        assert len(own) == max(1, -(-len(ids) // 64)) and (own["length"].iloc[1:] == 64).all()
        for r in own.itertuples():
            assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    check_sequences(got, 64)
    assert got["sequence_id"].nunique() <= -(-got["length"].sum() // 64) + 1
    assert packing.pack(docs(spark, []), BPE, RANKS).count() == 0


def check_sequences(got, most):
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s["offset"].tolist() == [0, *s["length"].cumsum().tolist()[:-1]] and s["length"].sum() <= most


@pytest.mark.parametrize("score", ["norm", "dot"])
@pytest.mark.parametrize(("max_docs", "max_cost"), [(None, None), (3, None), (None, 64 * 40), (2, 64 * 50)])
def test_best_fit_keeps_every_constraint(score, max_docs, max_cost):
    rnd = np.random.default_rng(5)
    counts = {int(n): int(rnd.integers(1, 30)) for n in rnd.choice(np.arange(1, 50), 25, replace=False)}
    plan = packing.best_fit(counts, 64, max_docs, max_cost, score)
    tokens, many, cost, seen = defaultdict(int), defaultdict(int), defaultdict(int), defaultdict(list)
    for r in plan.itertuples():
        seen[r.length] += range(r.first, r.first + r.pieces)
        for k in range(r.pieces):
            s = r.sequence + k // r.each
            assert tokens[s] == r.offset + k % r.each * r.length
            tokens[s] += r.length
            many[s] += 1
            cost[s] += r.length**2
    assert {n: sorted(x) for n, x in seen.items()} == {n: list(range(c)) for n, c in counts.items()}
    assert max(tokens.values()) <= 64 and max(many.values()) <= (max_docs or 64) and max(cost.values()) <= (max_cost or 64**2)
    assert sorted(tokens) == list(range(len(tokens)))


def test_toxicity_on_held_out_rows(spark):
    got = toxicity.op5_toxicity(spark, f"{DATA}/sf0.1").toPandas().set_index("doc_id")
    assert got["score"].between(0, 1).all() and (got["predicted"] == (got["score"] >= 0.3)).all()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.index]).all()
    labels = pd.read_parquet(f"{DATA}/sf0.1/labels.parquet").set_index("doc_id")["toxic"]
    test = got[got.index.isin(labels.index) & got["held_out"]]
    truth = labels[test.index]
    hit = (test["predicted"] == 1) & (truth == 1)
    assert hit.sum() / (truth == 1).sum() > 0.8 and hit.sum() / (test["predicted"] == 1).sum() > 0.85


def test_toxicity_of_odd_rows(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(len(TEXTS))], "doc_id long, toxic int")
    got = toxicity.score(docs(spark, [*TEXTS, None], [*range(len(TEXTS)), None]), *toxicity.fit(docs(spark, TEXTS), labels)).toPandas()
    assert len(got) == len(TEXTS) + 1 and got["score"].between(0, 1).all()
    one_class = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    assert toxicity.score(docs(spark, TEXTS), *toxicity.fit(docs(spark, TEXTS), one_class)).count() == len(TEXTS)
    assert toxicity.score(docs(spark, []), *toxicity.fit(docs(spark, []), one_class)).count() == 0


def test_toxicity_learns_only_from_rows_outside_the_held_out_part(spark):
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    labels = spark.createDataFrame([(i, 1) for i in held], "doc_id long, toxic int")
    net, _ = toxicity.fit(docs(spark, ["bad"] * 400), labels)
    assert not net.out.any()  # nothing to learn from


def test_a_table_of_word_types_that_overflows(monkeypatch):
    net = toxicity.Network()
    texts = ["a b c", "", "d e f g h", "a a a"]
    want = toxicity.Scorer(net).score(texts)
    monkeypatch.setattr(toxicity, "KEPT", 4)
    assert np.allclose(toxicity.Scorer(net).score(texts), want)


def test_a_score_depends_on_its_own_text_only():
    net = toxicity.Network()
    texts = ["a b c", "", "d e f g h", "a a a", ""]
    together = toxicity.Scorer(net).score(texts)
    assert np.allclose(together, [toxicity.Scorer(net).score([t])[0] for t in texts])
    assert np.allclose(together[::-1], toxicity.Scorer(net).score(texts[::-1]))


def test_main_texts_of_the_test_pages():
    pages = pd.read_parquet(f"{DATA}/sf0.01/pages.parquet")["html"].to_list()
    got = html_text.main_texts(pages, *html_text.model())
    for page, text in zip(pages, got, strict=True):
        article = re.search(r"<article>(.*?)(</article>|$)", page, re.S).group(1).replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert text == "\n".join(b for b in blocks if b)


def test_generated_pages_that_were_not_trained_on():
    pages = html_text.labelled_pages(120, seed=5)
    trees = [html_text.labelled_tree(p) for p in pages]
    forest = html_text.Forest([t for t, _ in trees])
    p, _ = forest.marginals(*html_text.model())
    leaf = forest.kind == 0
    assert ((p >= 0.5) == np.concatenate([y for _, y in trees]))[leaf].mean() > 0.99


def test_marginals_against_enumeration():
    tree = html_text.Tree("<div><p>a</p><ul><li>b</li></ul></div>")
    rnd = np.random.default_rng(1)
    w, ties = rnd.normal(size=html_text.WIDTH), rnd.normal(size=(html_text.KINDS, 2, 2))
    n = len(tree.parent)
    total, on = 0.0, np.zeros(n)
    for state in range(1 << n):
        x = [state >> k & 1 for k in range(n)]
        e = sum(w[tree.features[k]].sum() for k in range(n) if x[k]) + sum(ties[tree.kind[k], x[tree.parent[k]], x[k]] for k in range(1, n))
        total += np.exp(e)
        on += np.exp(e) * np.array(x)
    p, _ = html_text.Forest([tree]).marginals(w, ties)
    assert np.allclose(p, on / total)


def test_broken_pages(spark):
    pages = [None, "", "plain text", "<p>a <b>b", "<div>" * 3000 + "deep" + "</div>" * 10, "<p attr='>'>x</p></div></p>", "<script>never ends", "a < b & c &lt; d &am", "<ul><li>1<li>2</ul><table><tr><td>x<td>y</table>", "<!-- open", "<p>long</p>" * 20000]
    df = spark.createDataFrame([(k, "u", p, "t", 1) for k, p in enumerate(pages)], "page_id long, url string, html string, text string, n_chars int")
    got = {r["page_id"]: r for r in html_text.extract(df).collect()}
    assert len(got) == len(pages) and all(r["text"] is not None and r["n_chars"] == len(r["text"]) for r in got.values())
    assert got[0]["text"] == "" and html_text.extract(df.where("page_id < 0")).count() == 0
    assert list(html_text.Tree(pages[7]).text.values()) == ["a < b & c < d &am"]
    assert list(html_text.Tree(pages[8]).text.values()) == ["1", "2", "x", "y"]


ART = "The committee met on Tuesday to review the plan, and agreed that the budget should be raised."


@pytest.mark.parametrize(("inside", "blocks"), [
    ("<pre>x = 1\ny = 2</pre>", ["x = 1 y = 2"]),
    ("<dl><dt>Term</dt><dd>Its meaning</dd></dl>", ["Term", "Its meaning"]),
    ("<figure><img src=a><figcaption>A caption here</figcaption></figure>", ["A caption here"]),
    ("<details><summary>More info</summary><p>Hidden words of it.</p></details>", ["More info", "Hidden words of it."]),
    ("<p>Speed <math><mi>v</mi><mo>=</mo><mi>s</mi></math> end.</p>", ["Speed v=s end."]),
    ("<object><p>Fallback words are here.</p></object>", ["Fallback words are here."]),
    ("<h3>Sub title</h3><h6>Small</h6>", ["Sub title", "Small"]),
    ("<ol><li>First thing</li><li>Second</li></ol>", ["First thing", "Second"]),
    ("<table><tr><th>Year</th><th>Sum</th></tr><tr><td>2001</td><td>5</td></tr></table>", ["Year", "Sum", "2001", "5"]),
    ("<div>Unlabelled wrapper text of one line.</div>", ["Unlabelled wrapper text of one line."]),
    ("<div><div><p>Deep words here.</p></div></div>", ["Deep words here."]),
    ("<p>&am<b>p;</b> &l<i>t;</i> &amp;lt; x</p>", ["&amp; &lt; &lt; x"]),
    ("<p>Some <button>text that is open</p><p>Next words of it.</p>", ["Some text that is open", "Next words of it."]),
    ("<p>Press <button>OK</button> to go <svg><title>icon</title></svg> on</p>", ["Press to go on"]),
    ("<form><label>Name</label><input></form>", []),
    ("<aside><h3>Related</h3><ul><li><a href=x>Other story</a></li></ul></aside>", []),
    ("<div class=comments><div class=comment><p>I liked it very much, thanks.</p></div></div>", []),
])
def test_elements_of_articles(inside, blocks):
    page = f"<html><body><nav><ul><li><a href=/>Home</a></li></ul></nav><article><h1>Title here</h1><p>{ART}</p>{inside}<p>{ART}</p></article><footer>&copy; 2020 Example</footer></body></html>"
    assert html_text.main_texts([page], *html_text.model())[0].split("\n") == ["Title here", ART, *blocks, ART]


@pytest.mark.parametrize("page", ['<a "' * 250_000, "<div>" * 30_000 + "</p>" * 100_000, '<a "' * 100_000 + 'x>"', "<button>" * 100_000 + "x", "<svg>" * 100_000, "<li><ul>" + "<div>" * 20_000 + "<li></li>" * 50_000, "<" * 1_000_000, "<!--" * 200_000], ids=range(8))
def test_pages_are_read_in_linear_time(page):
    import time

    began = time.process_time()
    html_text.Tree(page)
    assert time.process_time() - began < 2


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string, cell int, row string")


def brute_knn(rows, k):
    ok = [(n, i, np.floor(1024 * np.array(v, dtype=np.float32).astype(float)).astype(int)) for n, (i, v, *_) in enumerate(rows) if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, i, v in ok:
        if i is not None and i % 100 == 0:
            found = sorted((-int(v @ w), j is None, j or 0, m) for m, j, w in ok if m != n and len(w) == len(v))
            out += [(i, r + 1, None if f[1] else f[2], -f[0]) for r, f in enumerate(found[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("sub", [4000, 7])
def test_search(spark, monkeypatch, sub):
    from pyspark.sql import functions as F

    monkeypatch.setattr(knn_join, "BUNDLE_ROWS", sub)
    monkeypatch.setattr(knn_join, "QUERY_ROWS", sub)
    rnd = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rnd.normal(size=4)]) for i in range(300)] + [(i, [0.5, 0.5, 0.5, 0.5]) for i in range(300, 420)]
    rows += [(500, None), (600, [1.0, None, 1.0, 1.0]), (700, [float("nan")] * 4), (800, [float("inf")] * 4), (900, [1.0, 2.0]), (901, [3.0, 1.0]), (1000, []), (None, [9.0, 9.0, 9.0, 9.0]), (1100, [0.1] * 4), (1100, [0.1] * 4)]
    rows = [(*r, "s", 1, "r") for r in rows]
    df = knn_join.knn_join(vectors(spark, rows), F.col("vec_id") % 100 == 0)
    got = sorted(((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect()), key=str)
    assert got == brute_knn(rows, 10)


def test_search_in_nothing(spark):
    from pyspark.sql import functions as F

    assert knn_join.knn_join(vectors(spark, []), F.col("vec_id") % 100 == 0).count() == 0
    assert knn_join.knn_join(vectors(spark, [(1, [1.0], "", 1, "")]), F.col("vec_id") % 100 == 0).count() == 0


def test_near_queries_share_groups_and_need_fewer_cells():
    """Clustered vectors: groups by pivots need fewer replicated rows than the same number of groups dealt at random."""
    rnd = np.random.default_rng(3)
    pivots = rnd.normal(size=(32, 6)) * 50
    order = knn_join.neighbours(pivots)
    assert sorted(order) == list(range(32))
    step = np.linalg.norm(np.diff(pivots[order], axis=0), axis=1).mean()
    assert step < 0.9 * np.linalg.norm(np.diff(pivots, axis=0), axis=1).mean()
    first, parts = knn_join.groups(np.array([10, 2500, 0, 900, 200]), [0, 4, 3, 1, 2])
    assert first.tolist() == [0, 2, 5, 1, 0] and parts.tolist() == [1, 3, 1, 1, 1]


def test_replicated_rows_of_clustered_vectors(spark, monkeypatch):
    from pyspark.sql import functions as F

    from lobspark.llm import shared

    monkeypatch.setattr(knn_join, "QUERY_ROWS", 4)
    monkeypatch.setattr(knn_join, "BUNDLE_ROWS", 60)
    sizes, real = {}, shared.write_out
    monkeypatch.setattr(shared, "write_out", lambda df, name: sizes.setdefault(name, real(df, name)))
    rnd = np.random.default_rng(4)
    centres = rnd.normal(size=(8, 6)) * 100
    rows = [(i, [float(x) for x in centres[i % 8] + rnd.normal(size=6)], "s", 1, "r") for i in range(1600)]
    got = sorted(((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in knn_join.knn_join(vectors(spark, rows), F.col("vec_id") % 100 == 0).collect()), key=str)
    assert got == brute_knn(rows, 10)
    met = sizes["meetings"].toPandas()
    cells = sizes["places"].select("cell").distinct().count()
    assert not met.duplicated().any()  # a block and a bundle meet once, so a query is sent to a bundle once
    assert len(met) < 0.5 * met["block"].nunique() * -(-1600 // 60) and met["bundle"].nunique() > cells / 3


def test_summaries_bound_all_scores():
    """No winner of any query lies in a cell that the summaries rule out, and some cells are ruled out."""
    rnd = np.random.default_rng(6)
    x = (rnd.normal(size=(6, 5))[rnd.integers(0, 6, 900)] * 300 + rnd.normal(size=(900, 5)) * 20).astype(int).astype(float)
    pivots = x[:25]
    d = np.linalg.norm(x[:, None] - pivots, axis=2)
    cell, dist = d.argmin(axis=1), d.min(axis=1)
    size = np.bincount(cell, minlength=25)
    radius = np.array([dist[cell == c].max(initial=0) for c in range(25)])
    asking = rnd.random(900) < 0.3
    spread = np.array([dist[(cell == c) & asking].max(initial=0) for c in range(25)])
    own = np.unique(cell[asking])
    wanted = knn_join.needed(pivots, size, radius, own, spread[own], 10)
    for q in np.flatnonzero(asking):
        score = x @ x[q]
        score[q] = -np.inf
        best = np.argsort(-score, kind="stable")[:10]
        least = score[best[-1]]
        assert wanted[np.searchsorted(own, cell[q])][np.unique(cell[(score >= least) & (np.arange(900) != q)])].all()
    assert 0 < wanted.sum() < 0.6 * wanted.size
    assert knn_join.needed(pivots, size, radius, own, spread[own], 899).all()


def test_large_cells_are_parted_and_small_ones_share_bundles(monkeypatch):
    monkeypatch.setattr(knn_join, "BUNDLE_ROWS", 100)
    first, parts = knn_join.bundles(np.array([30, 250, 0, 90, 20]), [0, 4, 3, 1, 2])
    assert first.tolist() == [0, 2, 5, 1, 0] and parts.tolist() == [1, 3, 1, 1, 1]


def mixing_table(spark, n=3000, seed=5):
    rnd = np.random.default_rng(seed)
    words = {g: [f"{g}{k}" for k in range(60)] for g in "xyz"}
    rows = []
    for i in range(n):
        g = str(rnd.choice(list("xyz"), p=[0.7, 0.2, 0.1]))
        source = str(rnd.choice(["hot", "b", "c", "rare"], p=[0.6, 0.3, 0.09, 0.01]))
        rows.append((i, " ".join(rnd.choice(words[g], rnd.integers(0, 40))), g if rnd.random() < 0.9 else None, source))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_mixing_against_brute_force(spark):
    """Probabilities solve the raking equations, as sums over all rows; and kept is the hash of the id below them."""
    import struct

    import xxhash

    targets = mixing.Targets(shares={"source": {"rare": 0.05}, "lang": {"x": 0.5}})
    df = mixing_table(spark)
    got = mixing.mix(df, targets).toPandas().sort_values("doc_id", ignore_index=True)
    assert len(got) == 3000 and got["n_tokens"].tolist() == [len(r["text"].split()) for r in df.orderBy("doc_id").collect()]
    total = got["n_tokens"].sum()
    for m in ("lang", "topic"):
        own = got.groupby(m)["n_tokens"].sum()
        want = pd.Series(mixing.target_shares(own.to_dict(), m, targets))
        have = (got["n_tokens"] * got["probability"]).groupby(got[m]).sum()
        assert np.allclose(have[want.index] / have.sum(), want, atol=1e-5)
    short = 0.7 * total * 0.05 - got.loc[got["source"] == "rare", "n_tokens"].sum()
    assert have.sum() == pytest.approx(0.7 * total - short)
    by_source = got.groupby("source")
    rare = by_source.get_group("rare")
    assert (rare["probability"] == 1).all()  # its target is more than it has: taken whole, and no more
    assert ((got["probability"] == 1) == (got["weight"] * 0.7 >= 1)).all()
    cells = got.drop_duplicates(["source", "lang", "topic"]).set_index(["source", "lang", "topic"])["weight"]
    ratio = cells["hot"] / cells["b"].reindex(cells["hot"].index)
    assert np.allclose(ratio.dropna(), ratio.dropna().iloc[0])  # a[source] * b[lang] * c[topic]
    seed = xxhash.xxh64_intdigest(struct.pack("<i", 42), seed=42)
    draw = [xxhash.xxh64_intdigest(struct.pack("<q", int(i)), seed=seed) % (1 << 53) for i in got["doc_id"]]
    assert (got["kept"] == (np.array(draw) < got["probability"] * 2.0**53)).all()


def test_source_factors_solve_the_cut_equations():
    rnd = np.random.default_rng(6)
    mass, w = rnd.integers(0, 50, (200, 7)).astype(float), rnd.random(7) * 3
    w[2] = 0
    want = mass.sum(axis=1) * rnd.random(200)
    a = mixing.source_factors(mass, want, w)
    got = (mass * np.minimum(1, a[:, None] * w)).sum(axis=1)
    short = (mass * (w > 0)).sum(axis=1) <= want
    assert np.allclose(got[~short], want[~short]) and np.allclose(got[short], (mass * (w > 0)).sum(axis=1)[short])


def test_report_of_achieved_shares(spark):
    rows = mixing.with_topics(mixing.described(mixing_table(spark).withColumn("topic", F_lit("t")), "doc_id", "text"), None)
    cells = mixing.cells_of(rows)
    raked = mixing.Raking(cells, mixing.Targets(fraction=0.3))
    got = mixing.report(raked.probabilities(), cells).toPandas().set_index(["marginal", "category"])
    assert raked.error < 1e-6 and np.allclose(got["target"], got["achieved"], atol=1e-5)
    assert np.allclose(got["observed"].groupby("marginal").sum(), 1)


def F_lit(x):
    from pyspark.sql import functions as F

    return F.lit(x)


def test_topics_against_k_means_in_one_place(spark):
    rows = mixing.described(mixing_table(spark, 500), "doc_id", "text")
    topics, again = mixing.clusters(rows, topics=3), mixing.clusters(rows.repartition(7), topics=3)
    assert np.array_equal(topics.centres, again.centres)
    got = rows.collect()
    v, langs = np.array([np.frombuffer(bytes(r["vec"]), dtype=np.int8) for r in got]).astype(int), np.array([r["lang"] for r in got])
    for x in set(langs):
        assert (topics.means[x] == np.rint(v[langs == x].sum(axis=0) / (langs == x).sum())).all()
    apart = v - np.array([topics.means[x] for x in langs])
    near = (apart @ topics.centres.T).argmax(axis=1)
    moved = mixing.clusters(rows, topics=3, passes=mixing.PASSES + 1)
    assert np.allclose(moved.centres, mixing._unit(np.array([apart[near == k].sum(axis=0, dtype=float) for k in range(3)])))
    assert sorted(r["topic"] for r in mixing.with_topics(rows, topics).collect()) == sorted(f"t{k}" for k in near)


def test_mixing_odd_rows(spark):
    from pyspark.sql import functions as F

    df = docs(spark, TEXTS).withColumn("source", F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("s"), F.col("doc_id") % 3)))
    df = df.withColumn("__source", F.lit("mine")).withColumn("__own", F.lit(1))
    one = mixing.mix(df).toPandas().set_index("doc_id")
    assert len(one) == len(TEXTS) and set(one["source"]) == {"?", "s1", "s2"}
    assert one["n_tokens"].sort_index().tolist() == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in TEXTS]
    kept = mixing.sample(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == sorted(one.index[one["kept"]])
    assert {(r["__source"], r["__own"]) for r in kept.select("__source", "__own").collect()} == {("mine", 1)}
    with_topic = df.withColumn("topic", F.when(F.col("doc_id") % 2 == 0, F.lit("even")))
    assert set(mixing.mix(with_topic).toPandas()["topic"]) == {"even", "?"} and mixing.sample(with_topic).columns == with_topic.columns
    assert mixing.mix(docs(spark, [])).count() == 0 and mixing.sample(docs(spark, [])).count() == 0
    assert mixing.mix(docs(spark, [None, ""])).count() == 2


def test_training_rows_of_toxicity_are_bounded(spark):
    """Repeated ids teach once; words and rows are bounded by hash order; a huge labelled text neither fails nor crowds out others."""
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    ids = [i for i in range(400) if not held(i)]
    texts = ["bad awful words" if i % 3 == 0 else "fine kind words" for i in ids]
    frame = docs(spark, [*texts, *texts[:50] * 3, "word " * 10_000_000], [*ids, *ids[:50] * 3, 100_000])
    labels = spark.createDataFrame([*[(i, int(i % 3 == 0)) for i in ids], (100_000, 0), (None, 1)], "doc_id long, toxic int")
    seen = []
    real = toxicity.train
    try:
        toxicity.train = lambda words, y, langs, seed=7: seen.append(([list(w) for w in words], y)) or real([w for w in seen[-1][0]], y, langs, seed)
        toxicity.fit(frame, labels)
        toxicity.fit(frame, labels, train_rows=100)
        toxicity.fit(frame, labels, train_words=90)
    finally:
        toxicity.train = real
    assert len(seen[0][1]) == len(ids)  # without the text of 10,000,000 words
    assert 99 <= len(seen[1][1]) <= 100 and len(seen[2][1]) == 30


def test_scores_against_a_plain_forward_pass():
    """The network's logits, word by word and filter by filter."""
    net = toxicity.Network()
    for text in ["", "one", "two words", "a b c d a b"]:
        words = text.split()
        vec = [net.table[toxicity.word_pieces(w)].sum(axis=0) for w in words]
        pooled, k = [], 0
        for width in toxicity.WIDTHS:
            at = [sum((vec[i + j] @ net.filters[k + j] if 0 <= i + j < len(vec) else 0 * net.bias[:8]) for j in range(width)) for i in range(-toxicity.TAIL if not words else 0, max(len(words), 1))]
            at.append(np.zeros(toxicity.FILTERS))  # the empty words behind a text
            pooled.append(np.max(at, axis=0))
            k += width
        logit = np.maximum(np.concatenate(pooled) + net.bias, 0) @ net.out + net.out_bias
        assert np.allclose(toxicity.Scorer(net).score([text]), net.scores(np.array([logit])), atol=1e-5)


def test_raking_says_when_there_are_too_many_pairs(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_PAIRS", 3)
    cells = spark.createDataFrame([("s", lang, topic, 1.0) for lang in "ab" for topic in "xy"], "source string, lang string, topic string, mass double")
    with pytest.raises(ValueError, match="coarser"):
        mixing.Raking(cells, mixing.Targets())
    monkeypatch.setattr(mixing, "AT_ONCE", 1)  # a source at a time
    monkeypatch.setattr(mixing, "MOST_PAIRS", 4)
    assert mixing.Raking(cells, mixing.Targets()).probabilities().count() == 4


def test_toxicity_learns_from_all_labelled_rows(spark):
    """A word that only rows beyond the first part have is learnt."""
    ids = [i for i in range(3000) if zlib.crc32(str(i).encode()) % 4 != 2]
    turn = {r["id"]: r["turn"] for r in spark.createDataFrame([(i,) for i in ids], "id long").selectExpr("id", "xxhash64(id) as turn").collect()}
    first = set(sorted(ids, key=lambda i: turn[i])[:200])
    text = lambda i: ("grim words here" if i in first else "vile words here") if i % 3 == 0 else "kind words here"
    frame = docs(spark, [*map(text, ids), "calm " * 120_000], [*ids, 100_000])
    labels = spark.createDataFrame([*[(i, int(i % 3 == 0)) for i in ids], (100_000, 0)], "doc_id long, toxic int")
    net, own = toxicity.fit(frame, labels, train_rows=200)
    score = toxicity.Scorer(net).score(["vile words here", "kind words here", "grim words here"])
    assert score[0] > 0.8 and score[1] < 0.2 and score[2] > 0.5 and not hasattr(net, "sums")


def test_long_texts_go_through_in_pieces(monkeypatch):
    net = toxicity.Network()
    texts = [[f"w{(k * k + seed) % 97}" for k in range(many)] for seed, many in ((1, 500), (2, 3), (3, 0), (4, 260))]
    whole = toxicity._logits(net, toxicity.Numbered(texts), np.arange(4))
    monkeypatch.setattr(toxicity, "PIECE", 50)
    assert np.allclose(whole, toxicity._logits(net, toxicity.Numbered(texts), np.arange(4)))
