"""anti_join_redraw against SQL, where many orders have no free address in their first eight draws."""

import duckdb

from stateloom.plans.catalog import QUERIES, SQL


def test_redraw_is_its_whole_sql_and_holds_the_bounded_one(spark, tmp_path):
    spark.range(15000).selectExpr("id as c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(2000).union(spark.range(5)).selectExpr("id as o_orderkey").write.parquet(f"{tmp_path}/orders.parquet")
    db = duckdb.connect()
    for name in ("customer", "orders"):
        db.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    columns = "o_orderkey, attempt, address"
    sql = lambda name: sorted(db.execute(f"select {columns} from ({SQL[name]})").fetchall())
    whole = sql("anti_join_redraw_whole")
    for name in ("anti_join_redraw_whole", "anti_join_redraw"):
        assert sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).select(*columns.split(", ")).collect())) == whole
    bounded = sql("anti_join_redraw")
    assert len({r[0] for r in whole}) == len(whole) == 2000 > len(bounded) > 0
    assert bounded == [r for r in whole if r[1] < 8]
