"""Every query of the library against its SQL, on the smallest tables."""

import glob
from pathlib import Path

import __spark_entry__
import duckdb
import pytest
from loamstack.plans import catalog

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(p).stem} AS SELECT * FROM '{p}'")
    return con


def plain(rows):
    return sorted(tuple("null" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


#: Parts of the same run; test_phases.py looks at them.
SAME_RUN = {"kept_sizes", "removed_entries", "consolidated_changes", "consolidated_entries", "consolidated_state", "consolidated_reports", "consolidated_actions", "archive_records", "conserved", "superseded"}


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n not in SAME_RUN])
def test_query(spark, db, name):
    got = catalog.QUERIES[name](spark, str(DATA))
    columns = sorted(got.columns)
    rows = plain(got.select(*columns).collect())
    if name in catalog.SQL:
        want = db.execute(catalog.SQL[name])
        order = sorted(range(len(want.description)), key=lambda i: want.description[i][0])
        assert [want.description[i][0] for i in order] == columns
        assert rows == plain([r[i] for i in order] for r in want.fetchall())


def test_sql_is_for_queries():
    assert set(catalog.SQL) <= set(catalog.QUERIES)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_stored_tokens(spark):
    """Tokens and ids of the tables, made elsewhere, are those computed from the text."""
    from loamstack.functions import text as T
    e = spark.read.parquet(f"{DATA}/entries.parquet")
    assert e.where(T.tokens("text") != e.toks).isEmpty()
    assert e.where(T.entry_id("text", T.tokens("text")) != e.eid).isEmpty()
