"""The driver's contract."""

import __spark_entry__ as entry
from quillmark import catalog


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(catalog.queries()) <= set(entry.queries())
    assert len(catalog.oracle_sql()) > 100


def test_columns_agree(spark):
    import duckdb

    db = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    for name, text in catalog.oracle_sql().items():
        columns = sorted(r[0] for r in db.execute(f"DESCRIBE {text}").fetchall())
        assert columns == sorted(catalog.queries()[name](spark, "/root/testdata/sf0.001").columns), name
