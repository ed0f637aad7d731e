import glob
import os

import duckdb
import pytest

from parleyworks.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_its_sql(spark, data, name):
    c = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        src = f"{p}/*.parquet" if os.path.isdir(p) else p
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{src}'")
    df = queries.QUERIES[name](spark, data)
    cols = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)
    rel = c.execute(queries.ORACLE[name])
    at = [[x[0] for x in rel.description].index(k) for k in cols]
    assert got == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=repr)


COLUMNS = {
    "p1_found": ["group_fact_id", "fact_id"], "p2_found": ["session_id", "seq_no", "uuid"], "p3_found": ["src_table", "row_id", "field", "start_pos"], "p5_found": ["exchange_id", "field"],
    "p6_found": ["src_table", "row_id", "lang"], "p7_found": ["exchange_id_a", "exchange_id_b"], "p8_found": ["doc_id", "item_id"], "p10_found": ["doc_id", "start_pos"],
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_distinct_rows(spark, data, name):
    df = queries.QUERIES[name](spark, data)
    assert df.columns == COLUMNS[name]
    rows = df.collect()
    assert rows and len(rows) == len(set(rows))
