import os

from pagewright import session


def rows_at(spark, paths):
    local = [p.removeprefix("file:") for p in paths]
    assert all(len([f for f in os.listdir(p) if f.endswith(".parquet")]) <= 1 for p in local)
    return [spark.read.parquet(p).count() for p in paths]


def test_intermediate_tables_are_emptied(spark):
    paths, tables = [], []

    def make():
        a = session.write_through(spark.range(1000))
        b = session.write_through(a.filter("id % 2 = 0"))
        place = session.shared_folder(spark)
        c = session.write_bucketed(b, ["id"], place, 4)
        own = session._run.get()
        paths.extend(p for p, _ in own)
        tables.extend(t for _, t in own if t)
        return c.filter("id < 10")

    kept = len(session._loose)
    out = session.stored(spark, make)
    assert sorted(r.id for r in out.collect()) == [0, 2, 4, 6, 8]
    assert rows_at(spark, paths) == [0, 0, 0] and len(tables) == 1 and not spark.catalog.tableExists(tables[0])
    assert len(session._loose) == kept + 1


def test_runs_in_threads_keep_their_tables(spark):
    """Two runs at once, each of which empties its own tables only."""
    from concurrent.futures import ThreadPoolExecutor
    from threading import Barrier

    meet = Barrier(2, timeout=120)

    def run(n):
        def make():
            a = session.write_through(spark.range(n))
            meet.wait()  # both have written
            return session.write_through(a.filter("id > 0"))

        out = session.stored(spark, make)
        meet.wait()  # both have emptied
        return out.count()

    with ThreadPoolExecutor(2) as pool:
        assert list(pool.map(run, (10, 20))) == [9, 19]


def test_bucketed_tables_grow_and_are_found_again(spark):
    place = session.shared_folder(spark)
    for part in ("a", "b"):
        table = session.write_bucketed(spark.range(50).selectExpr("id", "id % 7 AS k", f"'{part}' AS part"), ["k"], place, 4, "part")
    assert table.count() == 100
    name = session.open_bucketed(spark, table.schema, ["k"], place, 4, "part")
    spark.sql(f"DROP TABLE {name}")  # as in a new session
    again = spark.table(session.open_bucketed(spark, table.schema, ["k"], place, 4, "part"))
    assert sorted((r.part, r["count"]) for r in again.groupBy("part").count().collect()) == [("a", 50), ("b", 50)]
    plan = again.filter("part = 'b'").groupBy("k").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
