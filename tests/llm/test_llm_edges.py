import pytest

from tests.edges import make
from tidewake.llm import queries


@pytest.mark.parametrize("kind", ["empty", "nulls"])
def test_queries_on_empty_tables_and_nulls(spark, tmp_path, kind):
    sf = make(spark, tmp_path / kind, kind)
    got = {name: query(spark, sf).collect() for name, query in queries.QUERIES.items()}
    if kind == "empty":
        assert not any(got.values())
    else:
        assert len(got["p10_statistics"]) == 48 and len(got["p4_found"]) == len({r["account_handle"] for r in got["p4_found"]}) > 0
