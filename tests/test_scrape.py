import json
import os

import pytest
from pyspark.sql import functions as F

from pagewright.operators import admission as A, jobs as J, scrape as S
from pagewright.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"



def test_from_request_to_document(spark):
    page = '<html lang="en"><title>Quay</title><meta name="description" content="Boats"><h1>Quay</h1><p>Nine <b>boats</b></p>'
    snapshot = spark.createDataFrame(
        [(1, "https://pier.example/quay", 404, "text/plain", page), (2, "https://pier.example/big", 200, "text/html", "x" * 500), (3, "https://pier.example/quay/", 200, "text/html", "later copy")],
        "page_id int, url string, status int, content_type string, html string",
    )
    rows = [
        (1, "https://pier.example/quay#noon", True), (2, "https://pier.example/big", True), (3, "https://pier.example/none", True),
        (4, "https://pier.example/quay", False), (5, "", True), (6, "https://github.com/tide/logger", True),
    ]
    asked = spark.createDataFrame(rows, "request_id int, url string, readable boolean")
    asked = asked.selectExpr("*", "'scrape' AS kind", "'' AS format", "CAST(NULL AS string) AS extract_schema").withColumn("plan", A.free_plan())
    dns = spark.createDataFrame([("pier.example", 0, "93.184.216.34"), ("github.com", 0, "140.82.112.3")], "host string, pos int, ip string")
    got = {r.request_id: r for r in S.scrape_results(asked, snapshot, dns, strategies=("github_repo",), body_cap=400).collect()}
    done = json.loads(got[1].status_json)
    assert (done["status"], done["pages_completed"]) == ("completed", 1)
    data = done["results"][0]["data"]
    assert data["content"] == page and data["markdown"] == "# Quay\n\nNine **boats**"
    assert data["metadata"] == {"title": "Quay", "description": "Boats", "language": "en", "status_code": 404, "strategy": "generic"}
    for i in (2, 3, 6):
        failed = json.loads(got[i].status_json)
        assert (failed["status"], failed["results"], failed["pages_total"]) == ("failed", [], 1)
    assert [(got[i].http_code, got[i].error, got[i].status_json) for i in (4, 5)] == [(400, "invalid request body", None), (400, "url is required", None)]
    assert got[6].stream == "scrape_jobs"


def test_unreadable_bodies_come_first(spark):
    asked = spark.createDataFrame([(1, "extract", "", None), (2, "crawl", "https://pier.example/", True)], "request_id int, kind string, url string, readable boolean")
    asked = asked.selectExpr("*", "'' AS format", "'' AS extract_schema", "5000 AS max_pages", "0 AS max_depth", "0 AS max_timeout").withColumn("plan", A.free_plan())
    dns = spark.createDataFrame([("pier.example", 0, "93.184.216.34")], "host string, pos int, ip string")
    rows = A.admit(asked, dns).orderBy("request_id").collect()
    assert (rows[0].http_code, rows[0].error, rows[0].max_pages) == (400, "invalid request body", 5000)
    assert (rows[1].http_code, rows[1].max_pages, rows[1].max_depth, rows[1].max_timeout, rows[1].format) == (202, 10, 3, 300, "markdown")


def test_writes_refresh_the_owner(spark):
    events = spark.createDataFrame([("j", 1, 10), ("j", 2, 500)], "job_id string, seq int, at long")
    kept = J.latest_status(J.status_writes(events, "at", F.lit(0))).first()
    assert (kept.expires_at, kept.owner_expires_at) == (4100, 4100)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")
def test_every_stored_page_becomes_a_document(spark):
    """At the shipped cap, over all stored URLs: pages of any size are read, and none is replaced by a made one."""
    pages = {r.page_id: r for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    rows = QUERIES["scrape_results_stored"](spark, FOLDER).collect()
    assert {r.request_id for r in rows} == set(pages) and len(rows) == len(pages)
    done = [json.loads(r.status_json) for r in rows]
    assert {d["status"] for d in done} == {"completed"}
    assert max(len(d["results"][0]["data"]["content"]) for d in done) == max(len(p.html) for p in pages.values())
