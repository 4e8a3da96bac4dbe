"""Acknowledged consumption, orphan timers and expiring status, across restarts."""

import pytest
from pyspark.sql import functions as F

from pagewright.operators import jobs as J
from pagewright.streaming import consumer as C, status as T

FIELDS = "entry_id string, enqueued_at timestamp, fields map<string,string>"


def write_files(spark, rows, schema, folder, files):
    """One file per part, read one a micro-batch in this order."""
    import os
    import time

    for i, part in enumerate(files):
        spark.createDataFrame([rows[k] for k in part], schema).coalesce(1).write.parquet(f"{folder}/{i}")
        past = time.time() - 1000 + i
        for d, _, names in os.walk(f"{folder}/{i}"):
            for n in names:
                os.utime(f"{d}/{n}", (past, past))
    return lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


def entry(i, url="http://h/%d", job=None):
    fields = {} if url is None else {"url": url % i if "%" in url else url}
    return f"{i}-0", None, fields | ({"job_id": job} if job else {})


def work(usable):
    return usable.select("job_id", F.concat(F.lit("page of "), "url").alias("page"))


RESULT = "job_id string, page string"


@pytest.mark.parametrize("dies_after", ["results", "stored", "acks", "acknowledged", None])
def test_a_run_that_dies_gives_each_job_once(spark, tmp_path, monkeypatch, dies_after):
    rows = [entry(i, job=f"j{i}") for i in range(6)] + [entry(6), entry(7, None), entry(8, job="j0", url="http://again/%d")]
    stream = write_files(spark, rows, FIELDS, str(tmp_path / "in"), [range(3), range(3, 6), range(6, 9)])
    path, calls = str(tmp_path / "out"), []
    enter = C.Ledger.enter

    def failing(self, batch, step, n):
        """Dies in the second micro-batch, before or after a step is entered."""
        calls.append((batch, step))
        if batch == 1 and (step, dies_after) in ((C.STORED, "results"), (C.ACKNOWLEDGED, "acks")):
            raise RuntimeError("killed")
        enter(self, batch, step, n)
        if batch == 1 and step == dies_after:
            raise RuntimeError("killed")

    if dies_after:
        monkeypatch.setattr(C.Ledger, "enter", failing)
        query = C.consume_queue(stream(), work, path, str(tmp_path / "cp"))
        with pytest.raises(Exception, match="killed"):
            query.awaitTermination(120)
        monkeypatch.setattr(C.Ledger, "enter", enter)
        first = {r.entry_id for r in C.acknowledged(spark, path).collect()}
        stored = {r.job_id for r in C.stored_results(spark, path, RESULT).collect()}
        assert first == {f"{i}-0" for i in range(6 if dies_after == "acknowledged" else 3)}
        assert stored == {f"j{i}" for i in range(3 if dies_after == "results" else 6)}  # a result before its acknowledgement
    again = C.consume_queue(stream(), work, path, str(tmp_path / "cp"))
    again.awaitTermination(120)
    got = C.stored_results(spark, path, RESULT).collect()
    assert {(r.job_id, r.page) for r in got} == {*((f"j{i}", f"page of http://h/{i}") for i in range(1, 6)), ("j0", "page of http://again/8"), ("6-0", "page of http://h/6")} and len(got) == 7
    assert {r.entry_id for r in C.acknowledged(spark, path).collect()} == {r[0] for r in rows}
    assert spark.read.parquet(f"{path}/results").count() == 8  # nothing twice: one row per usable entry


LOG = "stream string, grp string, entry_id string, kind string, at timestamp"


def log_rows(spec):
    """(entry, kind, second) triples of one group, or (entry, kind, second, group)."""
    import datetime

    zero = datetime.datetime(2024, 1, 1)
    return [("s", (x[3:] or ("g",))[0], f"{x[0]}-0", x[1], zero + datetime.timedelta(seconds=x[2])) for x in spec]


def test_orphans_of_a_replayed_log_equal_the_batch_form(spark, tmp_path):
    spec = [(i, "deliver", i) for i in range(8)] + [(i, "deliver", i, "h") for i in range(3)]
    spec += [(1, "ack", 10), (2, "deliver", 40), (4, "ack", 59), (9, "ack", 5), (9, "deliver", 6)]
    spec += [(100, "deliver", 85), (5, "ack", 86)]  # at 85 s less the delay, entries 0 and 3 to 7 of g have been idle for 60
    spec += [(100, "ack", 200), (0, "ack", 200, "z"), (101, "ack", 300), (102, "ack", 300)]
    rows = log_rows(spec)
    cuts = [range(0, 8), range(8, 16), range(16, 18), range(18, 20), range(20, 21), range(21, 22)]
    stream = write_files(spark, rows, LOG, str(tmp_path / "in"), cuts)
    changes = C.idle_entries(stream().withWatermark("at", "0 seconds"), event_time="at")
    C.claim_orphans(changes, str(tmp_path / "out"), str(tmp_path / "cp"), "new", limit=4).awaitTermination(240)
    got = C.claimed(spark, str(tmp_path / "out"))
    # The batch form over the whole log: idle time at its end, since the last delivery.
    log = spark.createDataFrame(rows, LOG)
    last = log.filter("kind = 'deliver'").groupBy("stream", "grp", "entry_id").agg(F.max("at").alias("at"))
    claims = last.withColumn("idle_ms", (F.lit(300) - F.expr("unix_seconds(at) - unix_seconds(timestamp'2024-01-01')")) * 1000)
    acks = log.filter("kind = 'ack'").select("stream", "grp", "entry_id")
    want = {(r.grp, r.entry_id) for r in J.orphaned_entries(claims, acks).collect()}
    assert {(r.grp, r.entry_id) for r in got.collect()} >= want and got.count() == got.select("grp", "entry_id").distinct().count()
    extra = {(r.grp, r.entry_id) for r in got.collect()} - want
    assert extra <= {("g", "5-0")}  # acknowledged after its timer had gone off
    assert all(r["count"] <= 4 for r in got.groupBy("batch", "stream", "grp").count().collect()) and {r.consumer for r in got.collect()} == {"new"}


def test_the_clock_finds_idle_entries(spark, tmp_path):
    import time

    stream = write_files(spark, log_rows([(1, "deliver", 0), (2, "deliver", 0), (1, "ack", 0)]), LOG, str(tmp_path / "in"), [range(3)])
    run = lambda: C.claim_orphans(C.idle_entries(stream(), idle_ms=1), str(tmp_path / "out"), str(tmp_path / "cp"), "new").awaitTermination(120)
    run()
    assert C.claimed(spark, str(tmp_path / "out")).count() == 0
    time.sleep(1)
    write_files(spark, log_rows([(3, "ack", 0)]), LOG, str(tmp_path / "in" / "more"), [range(1)])
    run()  # restarted: the timers are in the state
    assert [r.entry_id for r in C.claimed(spark, str(tmp_path / "out")).collect()] == ["2-0"]


STATUS = "job_id string, seq long, status string, owner string, pages_total int, pages_completed int, expires_at long"


def test_status_expires_with_its_owner_across_restarts(spark, tmp_path):
    path, ask = str(tmp_path / "out"), "job_id string, caller string, now long"
    first = [("a", 1, "queued", "o", 1, 0, 100), ("b", 2, "completed", "o", 1, 1, 50), ("c", 3, "queued", "p", 1, 0, 60)]
    stream = write_files(spark, first, STATUS, str(tmp_path / "in"), [range(3)])
    T.maintain_status(stream(), path, str(tmp_path / "cp"), buckets=4, now=F.lit(0)).awaitTermination(120)

    def codes(*asked):
        rows = T.lookup_status(spark.createDataFrame(asked, ask), path, "now", buckets=4).collect()
        return {(r.job_id, r.caller, r.now): r.http_code for r in rows}

    assert codes(("a", "o", 99), ("a", "o", 100), ("b", "o", 49), ("b", "o", 50), ("c", "o", 1), ("c", "p", 1), ("x", "o", 1)) == {
        ("a", "o", 99): 200, ("a", "o", 100): 404, ("b", "o", 49): 200, ("b", "o", 50): 404, ("c", "o", 1): 404, ("c", "p", 1): 200, ("x", "o", 1): 404}
    # A second run finds the stored rows; a write refreshes a job, b has expired by then and leaves.
    more = write_files(spark, [("a", 4, "completed", "o", 1, 1, 500), ("d", 5, "queued", "o", 1, 0, 90)], STATUS, str(tmp_path / "in2"), [range(2)])
    T.maintain_status(more(), path, str(tmp_path / "cp2"), buckets=4, now=F.lit(55)).awaitTermination(120)
    T.expire_status(spark, path, F.lit(55))
    assert sorted(r.job_id for r in T.read_status(spark, path).collect()) == ["a", "c", "d"]
    assert codes(("a", "o", 499), ("a", "o", 500), ("c", "p", 59), ("c", "p", 60)) == {("a", "o", 499): 200, ("a", "o", 500): 404, ("c", "p", 59): 200, ("c", "p", 60): 404}
    assert sorted(r.job_id for r in T.read_status(spark, path, F.lit(90)).collect()) == ["a"]
    T.expire_status(spark, path, F.lit(1000))
    assert T.read_status(spark, path).count() == 0 and codes(("a", "o", 1)) == {("a", "o", 1): 404}
    T.expire_status(spark, path, F.lit(1000))
