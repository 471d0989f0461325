import pytest
from comparing import DATA, same

import corpus_pipeline
from lobspark.llm import catalog, shared


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_its_sql(spark, name):
    assert same(spark, catalog.QUERIES[name], catalog.SQL[name], "sf0.001")


def test_all_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in catalog.QUERIES) == list(range(1, 14))


def test_stages_against_brute_force(spark):
    """Each stage on what the one before kept: decisions are those of the operators' brute-force versions."""
    import re

    from test_dedup import brute_components

    path = f"{DATA}/sf0.01"
    docs = shared.table(spark, path, "documents")
    columns, frames = docs.columns, [docs.toPandas().set_index("doc_id")]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = shared.write_out(stage(spark, docs, path), "stage")
        assert docs.columns == columns
        frames.append(docs.toPandas().set_index("doc_id"))
    toxic, exact, near, mixed = frames[1:]
    labels = shared.table(spark, path, "labels").toPandas().set_index("doc_id")["toxic"]
    clean = labels[labels == 0].index
    assert toxic.index.isin(clean).sum() > 0.97 * len(clean)
    norm = toxic["text"].map(lambda t: re.sub(r"[\x20\x09-\x0D]", "", t))
    best = {k: min(g.index, key=lambda i: (-len(toxic["text"][i]), i)) for k, g in norm.groupby(norm)}
    assert set(exact.index) == set(best.values())
    groups = brute_components(exact["text"].to_list(), exact.index.to_list(), least=80)
    assert set(near.index) == {c for _, c in groups.values()}
    share = mixed["text"].str.len().sum() / near["text"].str.len().sum()
    assert set(mixed.index) <= set(near.index) and 0.6 < share < 0.8
    for frame in frames[1:]:
        assert (frame["text"] == frames[0]["text"][frame.index]).all()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, path).toPandas()
    assert set(packed["doc_id"]) == set(mixed.index)
    assert packed["sequence_id"].nunique() <= -(-packed["length"].sum() // 2048) + 2


def test_run_is_the_stages(spark):
    assert corpus_pipeline.run(spark, f"{DATA}/sf0.001").count() > 0


ODD = ["", None, " \t\n", "one two three four five six seven", "one two three four five six seven", "one  two three four five six seven", "ünï 中文 😀 " * 40, "word " * 60_000, "a b c d e f g h i j", "a b c d e f g h i k"]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
@pytest.mark.parametrize("rows", ["odd", "repeated", "none"])
def test_stages_with_odd_rows(spark, tmp_path, name, rows):
    """Nulls in any column, empty and long texts, ties, repeated rows and ids, clashing names, empty tables: every stage
    gives rows it was given, with the columns it was given (the last: pieces of them)."""
    ids = {"odd": [*range(len(ODD) - 2), None, None], "repeated": [1] * len(ODD), "none": []}[rows]
    texts = ODD[: len(ids)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, __row long, __own string, __score double, __source string, topic_ string, row string, id int"
    odd = [(i, t, "en" if k % 3 else None, "s" if k % 2 else None, None, k, None, 0.5, "mine", "x", "r", 1) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    docs = spark.createDataFrame(odd, schema)
    spark.createDataFrame([(i, 0, i % 2) for i in ids if i is not None] + [(None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = dict(corpus_pipeline.STAGES)[name](spark, docs, str(tmp_path))
    if name == corpus_pipeline.STAGES[-1][0]:
        pieces = got.toPandas()
        assert len(pieces) >= len(odd) and set(pieces["doc_id"].dropna()) == {i for i in ids if i is not None}
        return
    assert got.columns == docs.columns
    kept = [tuple(r) for r in got.collect()]
    assert all(kept.count(r) <= odd.count(r) for r in kept)
    if name == "exact dedup":
        assert len(kept) == {"odd": 6, "repeated": 6, "none": 0}[rows]  # blank ones are one text, so are the three of seven words
    if name == "near dedup":
        assert len(kept) == {"odd": 8, "repeated": 8, "none": 0}[rows]
