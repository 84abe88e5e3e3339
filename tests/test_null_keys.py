"""Queries over tables whose keys have nulls and ties, against their SQL."""

import duckdb

import __spark_entry__ as E


def same_as_sql(spark, tmp_path, name, table, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{table}.parquet"))
    own = E.queries()[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute("SET threads = 1")  # windows over tied rows sort alike
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    wanted = con.execute(E.oracle_sql()[name]).fetchall()
    assert sorted(map(repr, map(tuple, own.collect()))) == sorted(map(repr, wanted))
    return wanted


def test_interval_union_of_rows_without_keys(spark, tmp_path):
    rows = [(k, c) for c in (1, 2, None) for k in (100, 3100, 243, 900)] + [(None, 1), (None, 1), (None, None), (None, 3), (None, 3), (5, 4)]
    found = same_as_sql(spark, tmp_path, "interval_union", "orders", rows, "o_orderkey long, o_custkey long")
    assert sum(r[3] for r in found) == len(rows)
    assert sum(r[0] == 3 for r in found) == 2


def test_pages_of_parts_without_keys(spark, tmp_path):
    rows = [(k, f"part{'x' * (k % 7)} no", "B", f"type{k}", k, 1.0) for k in range(79)] + [(None, "longest of all parts", "B", "STAN", 3, 1.0)]
    found = same_as_sql(spark, tmp_path, "borderless_gutters", "part", rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double")
    assert len(found) == 4
