"""Every stage against a brute-force version on the small table."""

import collections

import pytest

import corpus_pipeline
from spendlens.llm import toxic_gru
from tests.llm import fixtures as fx
from tests.llm.test_operators import brute_leaks

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    out, docs = {}, spark.read.parquet(f"{SF}/documents.parquet")
    out["documents"] = docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        out[name] = docs.collect()
    return out


def ids(rows):
    return collections.Counter(r["doc_id"] for r in rows)


def test_toxicity(spark, stages):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts, labels = toxic_gru.labelled_sample(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    model = toxic_gru.train(texts, labels)
    keep = {r["doc_id"]: 1 for r in stages["documents"] if model.score(toxic_gru.pa.array([r["text"]]))[0] < 0.5}
    assert ids(stages["toxicity"]) == keep and 0 < len(keep) < len(stages["documents"])


def test_near_dedup(stages):
    want = fx.brute_classes([(r["doc_id"], r["text"]) for r in stages["toxicity"]])
    assert ids(stages["near_dedup"]) == {i: 1 for i in set(want.values())}


def test_decontamination(spark, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    want = brute_leaks([(r["doc_id"], r["text"]) for r in stages["near_dedup"]], items)
    assert ids(stages["decontamination"]) == {i: 1 for i, _, hit, _ in want if not hit}


def test_mixing(stages):
    size = lambda r: len(fx.WORD.findall(r["text"] or ""))
    before, after = stages["decontamination"], stages["mixing"]
    total, got = collections.Counter(), collections.Counter()
    for r in before:
        total[r["source"]] += size(r)
    for r in after:
        got[r["source"]] += size(r)
    largest = {s: max(size(r) for r in before if r["source"] == s) for s in total}
    assert sum(got.values()) == pytest.approx(1.5 * sum(total.values()), abs=sum(largest.values()))
    assert all(got[s] <= 2 * total[s] for s in total) and max(ids(after).values()) <= 2


def test_sharding_and_columns(stages):
    assert ids(stages["sharding"]) == ids(stages["mixing"])
    counts = collections.Counter(r["shard"] for r in stages["sharding"])
    assert max(counts.values()) - min(counts.values()) <= 1
    assert all(list(stages[name][0].asDict()) == COLUMNS for name in stages if name != "sharding")
    assert list(stages["sharding"][0].asDict()) == [*COLUMNS, "shard", "slot"]


def test_run(spark, stages):
    assert ids(corpus_pipeline.run(spark, SF).collect()) == ids(stages["sharding"])


def test_stages_on_odd_rows(spark):
    docs = fx.documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() > 5
        assert stage(spark, fx.documents(spark, []), SF).count() == 0, name
