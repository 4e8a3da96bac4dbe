"""The pipeline against its operators' brute-force versions, stage by stage."""

import random
import re

import pytest
from test_native import HEX, brute_base, brute_lines, prose
from test_ngram_join import plain

import corpus_pipeline
from pagewright.llm import outliers
from pagewright.llm.stages import COLUMNS


def corpus():
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.randrange(30, 200)) + "\n" + rng.choice(["All rights reserved", " all RIGHTS reserved ", "own line %d" % i]), "en", "s1") for i in range(90)]
    rows += [(200 + i, rows[i][1].replace("\n", " x\n", 1), "en", "s1") for i in range(20)]  # near copies
    rows += [(300 + i, rows[30 + i][1], "en", "s1") for i in range(10)]  # copies
    rows += [(400 + i, prose(rng, 60) + f"\npassword={HEX} and AKIA{'B' * 16}", "en", "s1") for i in range(8)]
    rows += [(500 + i, " ".join(w + "###" for w in prose(rng, 80).split()), "en", "s1") for i in range(6)]
    rows += [(600, None, "en", "s1"), (601, "", None, None), (602, "too short", "en", "s1"), (603, prose(rng, 3000), "en", "s1"), (None, prose(rng, 50), "en", "s1"), rows[0]]
    return rows


@pytest.fixture(scope="module")
def folder(spark, make_docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    make_docs(corpus()).write.parquet(f"{path}/documents.parquet")
    return path


def kept(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_stages(spark, folder):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality rules", "line dedup", "near duplicates", "secret scans", "best-fit packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = corpus()

    docs = stages["quality rules"](spark, docs, folder).cache()
    verdicts = {r.doc_id: r.kept for r in outliers.quality_verdicts(spark.read.parquet(f"{folder}/documents.parquet"), ["doc_id"]).collect()}
    want = sorted(((r[0], r[1]) for r in rows if verdicts[r[0]]), key=repr)
    assert kept(docs) == want and not {600, 601, 602, *range(500, 506)} & {d for d, _ in want} and len(want) > 120

    docs = stages["line dedup"](spark, docs, folder).cache()
    want = sorted(brute_lines(want, 10), key=repr)
    assert kept(docs) == want and not any("all rights reserved" in t.lower() for _, t in want)

    docs = stages["near duplicates"](spark, docs, folder).cache()
    first = {d for d, _, c in plain(want, 5, 80) if d is not None and d == c}
    want = sorted({(d, t) for d, t in want if d is None or d in first}, key=repr)
    assert kept(docs) == want and not {*range(200, 220), *range(300, 310)} & {d for d, _ in want}

    docs = stages["secret scans"](spark, docs, folder).cache()

    def redacted(t):
        spans = [tuple(map(int, x.split(":")[1:])) for x in brute_base(t).split(",") if x]
        joined = []
        for a, z in sorted(spans):
            if joined and a < joined[-1][1]:
                joined[-1][1] = max(z, joined[-1][1])
            else:
                joined.append([a, z])
        for a, z in reversed(joined):
            t = t[:a] + "[SECRET]" + t[z:]
        return t

    want = sorted(((d, redacted(t)) for d, t in want), key=repr)
    assert kept(docs) == want and sum("[SECRET] and [SECRET]" in t for _, t in want) == 8

    out = stages["best-fit packing"](spark, docs, folder).collect()
    words = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for d, t in want}
    assert {d: sum(r.length for r in out if r.doc_id == d) for d in words} == words
    for s in list(stages.values())[:-1]:
        assert s(spark, docs, folder).columns == list(COLUMNS)


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "piece", "start", "length", "bin_id", "capacity", "offset"] and out.count() > 80


def test_further_columns(spark, make_docs):
    extra = ("_base", "row", "id", "n_words", "kept", "_text", "dropped", "own", "component_id", "size", "_group")
    docs = make_docs([(i, f"line {i}\nshared words of every text " + "w%d " % i * 3 + " ".join(f"x{i}y{j}" for j in range(30)), None, None) for i in range(20)] + [(None, None, None, None)] * 2, extra)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and {r._base for r in out.collect()} == {"x"}


def test_stages_of_nothing(spark, make_docs):
    docs = make_docs([])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0
