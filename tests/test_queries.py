"""Every query gives the rows of its SQL, and some rows."""

import pytest
from oracle import compare, connect

from dossier import queries as _  # noqa: F401
from dossier.registry import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    df = QUERIES[name](spark, sf)
    if name not in ORACLE_SQL:
        assert df.count() > 0 or name == "fuzzy_name_pairs"
        return
    con = connect(sf)
    con.execute("SET TimeZone = 'UTC'")
    got, want = compare(df, con, ORACLE_SQL[name])
    assert got == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["query_id", "doc_id", "score", "rank"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
