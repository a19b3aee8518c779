"""Queries over program files where a customer's key, or what is made of it, has more than a header field's 32 bits."""

import duckdb
import pytest

from peltrane.plans import pe_catalogue

from .test_catalogue import values


@pytest.mark.parametrize("name", ["pe_headers", "pe_opcode_errors", "pe_opcodes", "pe_sections"])
def test_query_equals_sql(spark, tmp_path, name):
    con = duckdb.connect()
    keys = "SELECT unnest([65471, 65472, 65473, 65474, 131010, 900000, 899998, 4294967296, 5000000002, 5000000003])"
    con.execute(f"COPY ({keys} AS c_custkey) TO '{tmp_path}/customer.parquet' (FORMAT parquet)")
    con.execute(f"COPY (SELECT 7 * row_number() OVER () + 30000000 AS o_orderkey, c AS o_custkey FROM ({keys} AS c), range(4) WHERE c % 5 <> 3) TO '{tmp_path}/orders.parquet' (FORMAT parquet)")
    for t in ("customer", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    got = pe_catalogue.QUERIES[name](spark, str(tmp_path))
    want = con.execute(pe_catalogue.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    rows = values(want.fetchall(), names)
    assert rows and values(got.collect(), got.columns) == rows
