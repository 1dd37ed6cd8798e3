"""The pipeline's stages against brute force on their own inputs, and the registered queries."""

import collections

import corpus_pipeline
from compare import check, duck
from test_operators import brute_exact, brute_jaccard, pairs, words_of

from tessera.llm.queries import ORACLES, QUERIES
from tessera.plans.scratch import spill


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = spill(stage(spark, docs, sf))
        before, after = pairs(docs), pairs(out)
        if name != "piece_codec":
            assert out.columns == columns
        if name == "toxicity":
            toxic = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 1").collect()}
            gone = {i for i, _ in before} - {i for i, _ in after}
            assert gone and len(gone & toxic) >= 0.6 * len(gone)
        elif name == "exact_dedup":
            assert sorted(i for i, _ in after) == sorted({keep for _, keep, _, _ in brute_exact(before)})
        elif name == "jaccard_join":
            assert sorted(i for i, _ in after) == sorted({c for _, _, c in brute_jaccard(before)})
        elif name == "mix_sources":
            texts = dict(before)
            assert all(texts[i] == t for i, t in after) and max(collections.Counter(i for i, _ in after).values()) <= 2
            size = sum(len(words_of(t)) for _, t in before)
            assert abs(sum(len(words_of(t)) for _, t in after) / size - 1.5) < 0.35
        else:
            assert len(after) == len(before) and out.where("not round_trip").count() == 0
        docs = out


def test_queries_against_sql(spark, sf):
    con = duck(sf)
    for name, sql in ORACLES.items():
        assert check(spark, con, sf, QUERIES[name], sql) == "", name
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
