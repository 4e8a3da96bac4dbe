import random
from collections import deque

import pytest

from pagewright.operators import crawl as C
from pagewright.session import shared_folder
from pagewright.sources.snapshot import BODY_CAP, cap_body, fetch_error, fetch_outcomes
from pagewright.functions.sql import fn as F

JOBS = "job_id string, url string, max_pages int, max_depth int, include_patterns array<string>, exclude_patterns array<string>"
PAGES = "page_id long, url string, status int, content_type string, html string"


def queue_crawl(site, seed, max_pages, max_depth, limit):
    """First-in first-out re-statement over absolute links."""
    seen, queue, out, total = {seed}, deque([(seed, 0)]), [], 0
    while queue and len(out) < max_pages:
        url, depth = queue.popleft()
        status, html, links = site.get(url, (None, "", []))
        error = "fetch failed" if status is None else f"HTTP {status}" if status >= 400 else None
        size = 0 if error else len(html.encode())
        total += size
        if total > limit:
            out.append((url, depth, 0, "total crawl size limit exceeded"))
            break
        out.append((url, depth, size, error))
        if depth < max_depth and not error and html:
            for link in links:
                if link not in seen:
                    seen.add(link)
                    queue.append((link, depth + 1))
    return out


def test_random_graphs_equal_a_queue(spark):
    rnd = random.Random(11)
    pages, jobs, want, page_id = [], [], {}, 0
    for j in range(60):
        n = rnd.randrange(1, 25)
        urls = [f"http://s{j}/p{i}" for i in range(n + 3)]
        site = {}
        for i in range(n):
            links = [rnd.choice(urls) for _ in range(rnd.randrange(0, 6))]
            html = "".join(f'<a href="{u}">x</a>' for u in links) + "y" * rnd.randrange(0, 300)
            status = rnd.choice([200, 200, 200, 404])
            site[urls[i]] = (status, html, list(dict.fromkeys(links)))
            pages.append((page_id, urls[i], status, "text/html", html))
            page_id += 1
        max_pages, max_depth = rnd.randrange(1, 20), rnd.randrange(0, 6)
        jobs.append((f"j{j}", urls[0], max_pages, max_depth, [], []))
        want[f"j{j}"] = queue_crawl(site, urls[0], max_pages, max_depth, 1500)
    rows = C.crawl(spark.createDataFrame(jobs, JOBS), spark.createDataFrame(pages, PAGES), byte_limit=1500).orderBy("job_id", "rank").collect()
    got = {}
    for r in rows:
        assert r["rank"] == len(got.setdefault(r.job_id, [])) + 1
        got[r.job_id].append((r.url, r.depth, r.bytes, r.error))
    assert got == want


def test_chain_star_and_summary(spark):
    pages = [(i, f"http://h/level{i}", 200, "text/html", f'<title>L{i}</title><a href="/level{i + 1}">n</a>') for i in range(5)]
    pages += [(10, "http://star/", 200, "text/html", "".join(f'<a href="/c{i}">c</a>' for i in range(20)))]
    pages += [(20 + i, f"http://star/c{i}", 200, "", "leaf") for i in range(20)]
    pages += [(50, "http://pdf/", 200, "application/pdf", "x"), (51, "http://gone/", 404, "text/html", "x")]
    jobs = [("chain", "http://h/level0", 100, 2, [], []), ("star", "http://star/", 5, 3, [], []), ("pdf", "http://pdf/", 5, 3, None, None), ("gone", "http://gone/", 5, 3, None, None), ("bad", "http://a b/", 5, 3, None, None)]
    asked, snapshot = spark.createDataFrame(jobs, JOBS), spark.createDataFrame(pages, PAGES)
    results = C.crawl(asked, snapshot)
    summary = {r.job_id: tuple(r)[1:] for r in C.crawl_summary(asked, results).collect()}
    assert summary == {
        "chain": ("completed", 3, 3, 3), "star": ("completed", 5, 5, 5), "pdf": ("completed", 1, 1, 0), "gone": ("completed", 1, 1, 0), "bad": ("failed", 0, 0, 0),
    }
    errors = {r.job_id: (r.status_code, r.error, r.bytes) for r in results.filter("job_id in ('pdf', 'gone')").collect()}
    assert errors == {"pdf": (200, "non-HTML content", 0), "gone": (404, "HTTP 404", 0)}
    docs = {r.job_id: r.results for r in C.crawl_results(results, snapshot).collect()}
    assert [x.data.metadata.title for x in docs["chain"]] == ["L0", "L1", "L2"]
    events = [tuple(r)[2:] for r in C.crawl_status_events(asked, results).filter("job_id = 'chain'").orderBy("seq").collect()]
    assert events == [("queued", 0), ("running", 0), ("running", 1), ("running", 2), ("running", 3), ("completed", 3)]


def test_trailing_slash_changes_relative_links(spark):
    pages = [(0, "http://h/", 200, "text/html", '<a href="d/">d</a>'), (1, "http://h/d", 200, "text/html", '<a href="x">x</a>'), (2, "http://h/d/x", 200, "text/html", "in"), (3, "http://h/x", 200, "text/html", "out")]
    rows = C.crawl(spark.createDataFrame([("j", "http://h/", 9, 3, [], [])], JOBS), spark.createDataFrame(pages, PAGES)).orderBy("rank").collect()
    assert [r.url for r in rows] == ["http://h/", "http://h/d/", "http://h/d/x"]


def test_fetch_outcomes(spark):
    pages = [(1, "http://h/a", 200, "text/html", "first"), (2, "http://h/a/", 200, "text/html", "copy"), (3, "http://h/b", 500, "text/html", "x"), (4, "http://h/c", 200, "Text/HTML", "x")]
    asked = spark.createDataFrame([("http://h/a#z",), ("http://h/b",), ("http://h/c",), ("http://h/none",)], "url string")
    got = {r.url: (r.error, r.content) for r in fetch_outcomes(asked, "url", spark.createDataFrame(pages, PAGES)).collect()}
    assert got == {"http://h/a#z": (None, "first"), "http://h/b": ("HTTP 500", ""), "http://h/c": ("non-HTML content", ""), "http://h/none": ("fetch failed", "")}


def test_body_cap(evaluate):
    long = "é" * (BODY_CAP // 2) + "é"
    (cut,) = evaluate([long], F.octet_length(cap_body(F.col("x"))))
    assert cut == BODY_CAP
    assert evaluate([long, "x"], cap_body(F.col("x"), "fail")) == [None, "x"]


def test_levels_do_not_move_the_site(spark, tmp_path):
    """The site is dealt out once; a level joins it without an exchange on its side."""
    pages = [(i, f"http://h/p{i}", 200, "text/html", f'<a href="/p{i + 1}">n</a>') for i in range(40)]
    site = C.CrawlStore(spark, shared_folder(spark)).site(C.crawl_site(spark.createDataFrame(pages, PAGES)))
    path = str(tmp_path / "frontier")
    frontier = spark.createDataFrame([("j", "http://h/p0", "http://h/p0", 1, 0, 0, "h", [], [], 5, 3)],
        "job_id string, url string, _norm string, rank long, depth int, _used long, _host string, _include array<string>, _exclude array<string>, _max_pages long, _max_depth int")
    frontier.write.parquet(path)
    level = C._fetch(spark.read.parquet(path), site, 1 << 30, "page_id")
    plan = level._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("SortMergeJoin"):]
    assert below.count("Exchange hashpartitioning(_norm") == 1
    assert level.count() == 1


def chain_and_tree():
    pages = [(i, f"http://h/p{i}", 200, "text/html", f'<a href="/p{i + 1}">n</a><a href="/p{i}">me</a>') for i in range(9)]
    pages += [(100 + i, f"http://t/n{i}", 200, "text/html", f'<a href="/n{2 * i + 1}">l</a><a href="/n{2 * i + 2}">r</a><a href="/n0">up</a>') for i in range(40)]
    return pages, [("chain", "http://h/p0", 20, 4, [], []), ("tree", "http://t/n0", 25, 4, [], []), ("short", "http://t/n1", 30, 1, [], [])]


def test_a_stopped_crawl_goes_on(spark, monkeypatch):
    """Stopped while it stores level 3, once before and once after its rows are written."""
    pages, jobs = chain_and_tree()
    asked, snapshot = spark.createDataFrame(jobs, JOBS), spark.createDataFrame(pages, PAGES)
    show = lambda df: sorted(map(tuple, df.collect()))
    want = show(C.crawl(asked, snapshot))
    enter, write, place = C.CrawlStore._enter, C.write_bucketed, shared_folder(spark)
    written = []

    def killed(self, depth, attempt, rows):
        if depth == 3:
            raise RuntimeError("killed")
        enter(self, depth, attempt, rows)

    def noted(df, columns, path, *rest):
        written.append(path)
        return write(df, columns, path, *rest)

    monkeypatch.setattr(C, "write_bucketed", noted)
    monkeypatch.setattr(C.CrawlStore, "_enter", killed)
    for _ in range(2):  # the second run finds the rows that the first one left behind
        with pytest.raises(RuntimeError, match="killed"):
            C.crawl(asked, snapshot, path=place)
    monkeypatch.setattr(C.CrawlStore, "_enter", enter)
    for (name,) in spark.sql("SHOW TABLES LIKE 'table_*'").select("tableName").collect():
        spark.sql(f"DROP TABLE {name}")  # a new driver knows no tables
    before = len(written)
    assert show(C.crawl(asked, snapshot, path=place)) == want
    assert before == 1 + 3 + 1 + 1 and len(written) - before == 2  # one site; levels 3 and 4 anew
    assert show(C.crawl(asked, snapshot, path=place)) == want and len(written) - before == 2


def test_a_level_reads_what_was_seen_where_it_lies(spark):
    pages, jobs = chain_and_tree()
    place = shared_folder(spark)
    C.crawl(spark.createDataFrame(jobs, JOBS), spark.createDataFrame(pages, PAGES), path=place)
    store = C.CrawlStore(spark, place)
    seeds = C._fetch(spark.createDataFrame([], "job_id string, url string, _norm string, rank long, depth int, _used long, _host string, _include array<string>, _exclude array<string>, _max_pages long, _max_depth int"), store.site(C.crawl_site(spark.createDataFrame(pages, PAGES))), 1 << 30, "page_id")
    store.open(seeds.schema)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fresh = C._discover(store.seen(), store.level(2), C._going_on(store.level(2)), 100)
        plan = fresh._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    anti = plan[plan.index("LeftAnti"):]
    seen = anti[anti.index("Bucketed: true"):]  # the scan below the join's right side
    right = [x for x in anti.splitlines() if "Exchange hashpartitioning(job_id" in x and "_norm" in x]
    assert len(right) == 1 and seen, plan
