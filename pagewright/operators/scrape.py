"""A scrape request from its body to the status document of its job."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as S

from pagewright.functions.sql import fn as F
from pagewright.functions.urls import normalize_url
from pagewright.operators.admission import admit
from pagewright.operators.jobs import GENERIC, job_status_json, result_data
from pagewright.operators.markdown import markdown
from pagewright.operators.pages import page_metadata
from pagewright.sources.snapshot import BODY_CAP, first_keys, worker_pages


def scrape_results(requests: DataFrame, snapshot: DataFrame, dns: DataFrame, strategies: tuple[str, ...] = (), key: str = "page_id", body_cap: int = BODY_CAP) -> DataFrame:
    """(request_id, http_code, error, stream, status_json): G4, U19, S1-S3, H5, H9, H14 and H15 in one plan.

    ``requests`` are scrape requests with their plan; ``snapshot`` has (key, url, status, content_type, html). Refused
    requests have no status document. An accepted one is answered from the first stored page of its URL: any
    status is a result, a URL outside the snapshot or a body over the cap is a failed job. No extractor but the generic
    one runs here; a strategy among the registered ``strategies`` counts as tried and failed.

    Requests match pages on narrow rows; each needed body moves once, and is read in the row it then stands in.
    """
    admitted = admit(requests, dns)
    first = first_keys(snapshot, key)
    norm = S.when(S.col("http_code") == 202, normalize_url(F.col("url")).col)
    asked = admitted.withColumn("_norm", norm).select("request_id", "http_code", "error", "stream", "strategy", "_norm").join(first, "_norm", "left").drop("_norm")
    pages = worker_pages(snapshot.select(key, "status", "html"), body_cap)
    met = asked.join(pages, key, "left")
    tried = S.when(S.col("strategy").isin(*strategies), S.col("strategy")) if strategies else S.lit(None).cast("string")
    carried = ("http_code", "error", "stream", "status", "html", "_fallback")
    rows = page_metadata(met.withColumn("_fallback", tried), "request_id", keep=carried)
    text = markdown(F.coalesce(F.col("html"), "")).col
    data = result_data(S.col("html"), text, S.col("title"), S.col("description"), S.col("language"), S.col("status"), S.lit(GENERIC), S.col("_fallback"))
    job = S.concat(S.lit("job-"), S.col("request_id"))
    document = job_status_json(job, S.col("html").isNotNull(), data)
    return rows.select("request_id", "http_code", "error", "stream", S.when(S.col("http_code") == 202, document).alias("status_json"))
