import pytest

from tests.edges import make
from tidewake.plans import analysis, general


@pytest.mark.parametrize("kind", ["empty", "nulls"])
def test_queries_on_empty_tables_and_nulls(spark, tmp_path, kind):
    sf = make(spark, tmp_path / kind, kind)
    for name, query in {**general.QUERIES, **{k: analysis.QUERIES[k] for k in ("cascade_summary", "account_summary", "account_overlap", "account_roles", "burst", "token_hashtags")}}.items():
        rows = query(spark, sf).collect()
        assert not rows if kind == "empty" else rows or name in ("account_overlap",), name
