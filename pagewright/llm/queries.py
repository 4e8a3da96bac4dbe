"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as S

from pagewright.functions.sql import fn as F
from pagewright.llm import bpe, chat, credentials, line_dedup, ngram_join, outliers, packing, pii, resampling, sharding, topk, variants, warc
from pagewright.sources.snapshot import read_pages, read_table


def _count(spans, kind: str):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").col


def op2_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    base = F.col("_base")
    out = credentials.scan_secrets(docs)
    counts = {f"n_{k}": _count(base, k) for k in ("assign", "access", "hex")}
    spans = credentials.span_text(F.array_sort(F.concat(base, F.col("_linked"))))
    return out.select("doc_id", *[c.alias(k) for k, c in counts.items()], F.sha2(credentials.span_text(base), 256).alias("base_sha256").col, spans.alias("spans").col)


def op3_hilbert_shards(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    cut = sharding.hilbert_shards(docs, 24)
    return cut.select("doc_id", "size", "text_crc32", S.lit("rows").alias("law"), "shard", "slot", S.lit(None).cast("int").alias("grown_shard"))


def op4_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    marked = line_dedup.with_bitmaps(docs, line_dedup.line_drop_bitmaps(docs))
    gone = F.coalesce(F.aggregate(F.col("dropped"), 0, lambda a, r: a + (r["last"] - r["first"]) + 1), 0)
    kept = F.coalesce(line_dedup.kept_text(F.col("text"), F.col("dropped")), "")
    return marked.select(
        "row.doc_id", F.size(line_dedup.text_lines(F.col("text"))).cast("long").alias("n_lines").col, gone.cast("long").alias("n_dropped").col,
        F.sha2(kept, 256).alias("kept_sha256").col,
    )


def op5_shingle_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.near_duplicates(read_table(spark, folder, "documents"), words=4, percent=85).select("doc_id", "n_shingles", "component_id")


def op6_quality_outliers(spark: SparkSession, folder: str) -> DataFrame:
    verdicts = outliers.quality_verdicts(read_table(spark, folder, "documents"), ["doc_id"])
    return verdicts.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    out = bpe.decode_ids(bpe.encode_text(docs).select("doc_id", "ids"))
    n = (S.octet_length("ids") / 4).cast("long")
    return out.select("doc_id", n.alias("n_tokens"), S.sha2("ids", 256).alias("ids_sha256"), S.sha2("decoded", 256).alias("decoded_sha256"))


def op8_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    labelled = pii.labelled_runs(docs)
    out = pii.find_personal_data(docs, pii.train_crf([f for f, _ in labelled], [t for _, t in labelled]))
    base = F.col("_base")
    spans = credentials.span_text(F.array_sort(F.concat(base, F.col("_field"))))
    return out.select("doc_id", *[_count(base, k).alias(f"n_{k}") for k in pii.KINDS], F.sha2(credentials.span_text(base), 256).alias("base_sha256").col, spans.alias("spans").col)


def op9_top_products(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_inner_products(read_table(spark, folder, "embeddings"), "vec_id", "embedding", "id % 50 = 0")


def op10_chat_repair(spark: SparkSession, folder: str) -> DataFrame:
    return chat.repair_turns(read_table(spark, folder, "conversations"))


def op1_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, folder, "documents"))


def op11_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    drawn = resampling.resample(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return variants.variant_groups(read_table(spark, folder, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


def op13_segment_reassembly(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archived_payloads(read_pages(spark, folder)).drop("defect")


QUERIES = {
    f.__name__: f
    for f in (
        op1_best_fit_packing, op2_secret_scan, op3_hilbert_shards, op4_line_dedup, op5_shingle_join, op6_quality_outliers, op7_bpe_round_trip, op8_personal_data, op9_top_products,
        op10_chat_repair, op11_importance_resampling, op12_spelling_variants, op13_segment_reassembly,
    )
}
