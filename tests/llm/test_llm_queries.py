"""The registered queries on the small stored tables: against SQL, or against brute force where SQL can't say it."""

import hashlib
import os
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from test_models import plain_cost, whole_text_encoding
from test_native import brute_stats
from test_pii import plain_spans

from pagewright.llm.oracles import ORACLES
from pagewright.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


def table(name):
    return duckdb.sql(f"SELECT * FROM '{FOLDER}/{name}.parquet'").fetchall()


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


@pytest.fixture(scope="module")
def texts():
    return {r[0]: r[1] for r in table("documents")}


@pytest.fixture(scope="module")
def result(spark):
    done = {}

    def run(name):
        if name not in done:
            done[name] = QUERIES[name](spark, FOLDER).collect()
        return done[name]

    return run


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    from compare import compare, connect

    assert compare(spark, connect(FOLDER), FOLDER, name, QUERIES[name], ORACLES[name]) is None


def test_packing(result, texts, word_list):
    held, bins = defaultdict(int), defaultdict(list)
    for r in result("op1_best_fit_packing"):
        held[r.doc_id] += r.length
        if r.bin_id is not None:
            bins[r.bin_id].append(r)
    assert held == {d: len(word_list(t)) for d, t in texts.items()}
    assert all(sum(r.length for r in rs) <= rs[0].capacity and len({r.offset for r in rs}) == len(rs) for rs in bins.values())


def test_shards(result, texts):
    rows = result("op3_hilbert_shards")
    assert {(r.doc_id, r["size"], r.text_crc32) for r in rows} == {(d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in texts.items()}
    shards = defaultdict(list)
    for r in rows:
        shards[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert set(shards) == set(range(24)) and all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1


def test_statistics(result, texts, word_list):
    for r in result("op6_quality_outliers"):
        n, chars, symbols, _, lines, repeats = brute_stats(texts[r.doc_id], word_list)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, repeats)
        assert r.base_failed == (n < 20 or 100 * repeats > 30 * n) and not (r.base_failed and r.kept)


def test_kept_documents_agree_with_labels(result):
    kept = {r.doc_id: r.kept for r in result("op6_quality_outliers") if not r.base_failed}
    good = [kept[d] for d, quality, _ in table("labels") if d in kept and quality]
    assert all(good) and len(good) > 20


def test_tokens(result, texts):
    enc = whole_text_encoding()
    for r in result("op7_bpe_round_trip"):
        ids = enc.encode_ordinary(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()))
        assert r.decoded_sha256 == sha(texts[r.doc_id] or "")


def test_personal_data(result, texts):
    for r in result("op8_personal_data"):
        spans = plain_spans(texts[r.doc_id])
        assert r.base_sha256 == sha(",".join(f"{k}:{s}:{e}" for s, _, e, k in spans))
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[3] == k for s in spans) for k in ("email", "ip", "card", "phone"))
        assert {f"{k}:{s}:{e}" for s, _, e, k in spans} <= set(r.spans.split(","))


def test_resampling_draws_a_quarter(result, texts):
    rows = result("op11_importance_resampling")
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    able = sum(len(word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) >= 20 for t in texts.values())
    drawn = sorted((r["rank"], -r.score, r.doc_id) for r in rows if r["rank"])
    assert len(rows) == len(texts) and [d[0] for d in drawn] == list(range(1, able * 25 // 100 + 1))
    assert [d[1:] for d in drawn] == sorted(d[1:] for d in drawn)


def test_chats(result):
    turns, cost = defaultdict(list), defaultdict(int)
    for conv, turn, role, _ in table("conversations"):
        turns[conv].append((turn, role))
    rows = result("op10_chat_repair")
    for r in rows:
        cost[r.conv_id] += r.cost
    assert len(rows) == sum(map(len, turns.values()))
    assert cost == {c: plain_cost([role for _, role in sorted(t)]) for c, t in turns.items()}


def test_types(spark):
    want = {
        "op2_secret_scan": "bigint bigint bigint bigint string string", "op3_hilbert_shards": "bigint bigint bigint string int bigint int",
        "op4_line_dedup": "bigint bigint bigint string", "op5_shingle_join": "bigint bigint bigint",
        "op6_quality_outliers": "bigint bigint bigint bigint bigint bigint boolean boolean", "op7_bpe_round_trip": "bigint bigint string string",
        "op8_personal_data": "bigint bigint bigint bigint bigint string string", "op9_top_products": "bigint int bigint bigint",
        "op11_importance_resampling": "bigint bigint bigint bigint bigint", "op12_spelling_variants": "string string string bigint bigint bigint", "op13_segment_reassembly": "bigint bigint string string bigint",
    }
    for name, kinds in want.items():
        assert [k for _, k in QUERIES[name](spark, FOLDER).dtypes] == kinds.split(), name


def test_registry():
    import __spark_entry__ as entry

    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in QUERIES}
    assert {*QUERIES, "pipeline"} <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
