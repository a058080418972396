"""Queries over files equal their SQL; every query of the catalogue has SQL."""

import duckdb
import pytest

from docloom import file_queries
from docloom.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
NAMES = [n for n, f in QUERIES.items() if f.__module__ == file_queries.__name__]


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, tmp_path, name):
    df = QUERIES[name](spark, SF)
    df.write.parquet(f"{tmp_path}/got")
    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cols = ", ".join(f'"{x}"' for x in sorted(df.columns))
    want, got = f"SELECT {cols} FROM ({ORACLE[name]})", f"SELECT {cols} FROM '{tmp_path}/got/*.parquet'"
    assert c.execute(f"SELECT count(*) FROM ({want})").fetchone()[0] > 0
    bad = f"(({want}) EXCEPT ALL ({got})) UNION ALL (({got}) EXCEPT ALL ({want}))"
    assert c.execute(bad).fetchall()[:4] == []


def test_names():
    assert NAMES == ["archive_source", "file_information", "paragraph_files", "csv_files", "mixed_types", "failure_status", "decoded_texts", "chunk_stream"]
