"""The corpus pipeline and the registered queries of this subpackage."""

import random
import sys
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import __spark_entry__
import corpus_pipeline
from compare import compare, connect
from flowlattice.llm import components, queries
from llm import brute

SMALL = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    names = set(__spark_entry__.queries())
    assert {"pipeline", *queries.QUERIES} <= names
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{k}" for k in range(1, 14)}
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality rules", "toxicity", "n-gram Jaccard join", "benchmark decontamination", "packing"]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_with_sql(spark, name):
    result = compare(queries.QUERIES[name](spark, SMALL), connect(SMALL), queries.ORACLES[name])
    assert result[0] is None, result


def test_stages_against_plain_versions(spark):
    docs = corpus_pipeline.table(spark, SMALL, "documents")
    kept, columns = [], docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()} if "text" in docs.columns else {}
        docs = corpus_pipeline.materialized(stage(spark, docs, SMALL), "stage")
        if name != "packing":
            assert docs.columns == columns
        kept.append((name, before, {r["doc_id"] for r in docs.select("doc_id").collect()}))
    stages = {name: (before, after) for name, before, after in kept}
    before, after = stages["quality rules"]
    assert not any(brute.base_rules(before[i])[5] for i in after) and len(after) > 0.7 * len(before)
    before, after = stages["n-gram Jaccard join"]
    assert after == set(brute.near_groups(list(before.items())).values())
    before, after = stages["benchmark decontamination"]
    items = [(r["item_id"], r["text"]) for r in corpus_pipeline.table(spark, SMALL, "benchmark").collect()]
    assert after == {i for (i, _), c in zip(before.items(), brute.contamination(before.values(), items)) if not c[4]}
    before, after = stages["packing"]
    assert after == set(before)


def test_components_of_random_links(spark):
    rng = random.Random(8)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1060)] + [(5000, k) for k in range(5001, 5100)]
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = components.components(spark.createDataFrame(links, "u bigint, v bigint")).collect()
    assert Counter(map(tuple, got)) == Counter((i, find(i)) for i in root)
    assert components.components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0
