import duckdb

from factgrid.queries import ORACLE_SQL, QUERIES


def test_halves_are_those_of_the_sql(spark, tmp_path):
    """Rates whose percentage has a 5 as second decimal: (events of a user, valid ones of them)."""
    rates = [(13, 7), (33, 28), (37, 19), (44, 13), (51, 14), (55, 8), (65, 9), (69, 1), (73, 5), (76, 41), (99, 84), (200, 107), (800, 427)]
    rows = [(u, 0 if k < good else 99) for u, (n, good) in enumerate(rates) for k in range(n)]
    df = spark.createDataFrame([(i, u, "t", f'{{"k": {k}}}') for i, (u, k) in enumerate(rows)], "event_id long, user_id long, event_type string, props string")
    df.selectExpr("*", "timestamp'2024-01-01 00:00:00' AS ts").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = {tuple(r) for r in QUERIES["a11_percentage"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert got == {*con.sql(ORACLE_SQL["a11_percentage"]).fetchall()} and len(got) == len(rates)
    assert ("2", "51.4%") in got and ("4", "27.4%") in got
