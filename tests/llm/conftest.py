import duckdb
import pytest

from quarry.llm.common import small_batches

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of (doc_id, text) rows."""
    small_batches(spark, 3)
    return lambda rows: spark.createDataFrame([(i, t, "en", None, None if t is None else len(t)) for i, t in rows], DOCS)


@pytest.fixture(scope="session")
def pages_of(spark):
    return lambda rows: spark.createDataFrame(rows, "page_id long, url string, html string")


@pytest.fixture(scope="session")
def oracle(sf):
    def run(sql, **tables):
        c = duckdb.connect()
        for t in ("documents", "pages", "benchmark", "labels"):
            if t in tables:
                c.register(t, tables[t])
            else:
                c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
        r = c.sql(sql)
        return r.columns, r.fetchall()
    return run


@pytest.fixture(scope="session")
def same(oracle):
    """Compares a DataFrame with SQL, rows as a multiset, columns by name."""
    def run(df, sql, **tables):
        cols, rows = oracle(sql, **tables)
        assert sorted(cols) == sorted(df.columns)
        order = [cols.index(c) for c in df.columns]
        want = sorted((tuple(r[i] for i in order) for r in rows), key=repr)
        got = sorted((tuple(r) for r in df.collect()), key=repr)
        assert got == want
    return run
