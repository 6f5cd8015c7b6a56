from pathlib import Path

import duckdb
import pytest

from sedimenta.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no tables")
COLUMNS = {"p2_found": ["project", "rel_path"], "p3_found": ["chunk_id_a", "chunk_id_b"], "p4_found": ["project", "rel_path"], "p5_found": ["chunk_id", "line_no"], "p7_found": ["chunk_id"], "p10_found": ["doc_id"]}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_runs(spark, name):
    df = QUERIES[name](spark, FOLDER)
    rows = list(map(tuple, df.collect()))
    if name in COLUMNS:
        assert df.columns == COLUMNS[name] and len(rows) == len(set(rows))
    if name in SQL:
        con = duckdb.connect()
        for p in Path(FOLDER).glob("*.parquet"):
            con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
        assert sorted(rows) == sorted(con.execute(SQL[name]).fetchall())
