import pytest
from comparing import DATA, same

from lobspark.plans import catalog, factory


def test_there_are_75_features():
    assert len(factory.available()) == 75


def test_every_feature_is_in_a_query():
    text = "\n".join(catalog.SQL.values())
    assert not [n for n in factory.available() if f" as {n}" not in text]


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_its_sql(spark, name):
    same(spark, catalog.QUERIES[name], catalog.SQL[name], "sf0.01" if name == "flow_pca" else "sf0.001")


def test_predictions_have_a_row_for_each_snapshot(spark):
    df = catalog.QUERIES["walk_forward_predictions"](spark, f"{DATA}/sf0.001").toPandas()
    assert len(df) and df["prediction"].notna().all()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
