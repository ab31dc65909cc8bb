"""Every query of the catalogue against its SQL in DuckDB, over the whole small tables."""

import pytest

from ruleframe import catalogue
from tests.compare import assert_same


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_matches_sql(spark, small, name):
    df = catalogue.QUERIES[name](spark, small)
    if df.isEmpty():  # a query without rows shows nothing: two have some in larger tables only
        assert not catalogue.QUERIES[name](spark, small.replace("sf0.001", "sf0.01")).isEmpty()
    if name in catalogue.SQL:
        assert_same(df, catalogue.SQL[name], small)
    else:
        assert df.columns


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["ruleset", "rule_id", "category", "kind", "n_incidents", "first_incident"]
    assert {*e.oracle_sql()} <= {*e.queries()}


def test_places_in_neighbouring_lines(spark, tmp_path):
    """A line that ends one place and begins the next counts in both, as in the SQL."""
    rows = [(1, "One day.\nAn.\nAn.\nAn end.\nAnd", "en", "s", 30), (2, "No.\n An.\nan", "en", "s", 11), (3, None, "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    (part,) = (tmp_path / "documents.parquet").glob("part-*.parquet")
    (tmp_path / "duck").mkdir()
    (tmp_path / "duck" / "documents.parquet").write_bytes(part.read_bytes())
    name = "filecontent_multiline_lines"
    assert assert_same(catalogue.QUERIES[name](spark, str(tmp_path / "duck")), catalogue.SQL[name], str(tmp_path / "duck")) == 4
