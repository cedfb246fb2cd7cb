"""Nothing lost, no caps: cases that earlier versions of the operators got wrong."""

import collections
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spendlens.llm import bag_minhash, line_runs, link_trust, mix_fill, ngram_leaks, toxic_gru
from spendlens.llm.words import LOWER, slices
from tests.llm import fixtures as fx
from tests.llm.test_operators import brute_leaks


def words(rng, n):
    return [f"w{rng.randrange(10_000)}" for _ in range(n)]


def test_no_text_is_lost_to_a_shared_key(spark):
    rng = random.Random(1)
    a, b, c = (" ".join(words(rng, 60)) for _ in range(3))
    rows = [(3, a), (7, a), (7, b), (9, b + " tail"), (None, c), (None, c), (5, c + " end"), (None, ""), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_row", F.lit("x"))
    kept = sorted((r["doc_id"], r["text"]) for r in bag_minhash.keep_one_per_class(docs.drop("_row")).filter("doc_id is not null").collect())
    assert kept == [(3, a), (5, c + " end"), (7, b)]
    assert bag_minhash.keep_one_per_class(docs).filter("doc_id is null").count() == 2  # the two without words
    classes = collections.Counter((r["doc_id"], r["class_id"]) for r in bag_minhash.near_classes(docs).collect())
    assert classes == {(3, 3): 1, (7, 3): 1, (7, 7): 1, (9, 7): 1, (5, 5): 1, (None, 5): 2, (None, None): 2}
    nulls = spark.createDataFrame([(None, a)] * 3, "doc_id long, text string")
    assert bag_minhash.keep_one_per_class(nulls).count() == 1


def test_a_large_group_is_measured_in_blocks(spark, monkeypatch):
    """A group whose members are about 0.7 to 0.85 alike, cut into many small blocks, has the classes of all pairs."""
    monkeypatch.setattr(bag_minhash, "BLOCK_NODES", 40)
    rng = random.Random(4)
    base, rows = words(rng, 150), []
    for i in range(260):
        text = list(base)
        for at in rng.sample(range(150), rng.randrange(1, 6)):
            text[at] = f"x{rng.randrange(10_000)}"
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["class_id"] for r in bag_minhash.near_classes(docs).collect()}
    assert got == fx.brute_classes(rows)


def test_lines_of_documents_with_text_keys(spark):
    line = "this line is long enough to count and stands in many documents"
    rows = [(f"d{i:03}", f"own line of document {i} that is long enough to be counted\n{line}") for i in range(40)] + [("d999", line), (None, line)]
    docs = spark.createDataFrame(rows, "doc_id string, text string").repartition(4)
    got = {r["doc_id"]: r for r in line_runs.drop_shared_lines(docs).collect()}
    assert {k for k, r in got.items() if r["n_dropped"] == 0} == {"d999"}
    assert all(r["kept"] == rows[i][1].split("\n")[0] for i, r in ((i, got[f"d{i:03}"]) for i in range(40)))


def chain(spark, n):
    """Hosts h0 -> h1 -> ... -> h(n-1), and the exact ranks by solving the linear equations."""
    edges = spark.createDataFrame([(f"h{i}", f"h{i + 1}", 1.0) for i in range(n - 1)], "src string, dst string, w double")
    hosts = spark.createDataFrame([(f"h{i}", float(i == 0), float(i == n - 1)) for i in range(n)], "host string, trust_seed double, distrust_seed double")
    step = np.zeros((n, n))
    for i in range(n - 1):
        step[i + 1, i] = 1.0
    out = {}
    for name, seed, way in (("trust", np.eye(n)[0], step), ("distrust", np.eye(n)[n - 1], step.T)):
        spread = way + np.outer(seed, 1 - way.sum(0))  # what has no link goes back to the seeds
        out[name] = np.linalg.solve(np.eye(n) - 0.85 * spread, 0.15 * seed)
    return hosts, edges, out


def test_propagation_reaches_the_end_of_a_long_chain(spark):
    hosts, edges, want = chain(spark, 60)
    unit = 10.0  # as on a table with more seed pages than a host has pages
    got = {r["host"]: r for r in link_trust.propagate(hosts.withColumns({"trust_unit": F.lit(unit), "distrust_unit": F.lit(unit)}), edges, tolerance=1e-5).collect()}
    for i in range(60):
        assert got[f"h{i}"]["trust"] * unit == pytest.approx(want["trust"][i] * unit, abs=1e-4)
        assert got[f"h{i}"]["distrust"] * unit == pytest.approx(want["distrust"][i] * unit, abs=1e-4)


def test_any_number_of_sources_is_mixed(spark):
    n = 150_000
    sized = spark.range(n).select(
        F.concat(F.lit("host"), F.col("id")).alias("source"), (F.col("id") % 7 + 1).alias("size"), F.md5(F.col("id").cast("string")).alias("draw"))
    plan = mix_fill.plan_mix(sized)
    total = plan.agg(F.count("*").alias("n"), F.sum("target").alias("t"), F.max(F.col("target") - 2 * F.col("source_size")).alias("over")).first()
    assert total["n"] == n and total["t"] == pytest.approx(1.5 * sum(i % 7 + 1 for i in range(n))) and total["over"] <= 0


def test_rows_without_a_key_come_near_their_target(spark):
    rows = [(None, f"{'a b c d e f g h i j'}", "s")] * 90 + [(None, "k " * 10 + str(i), "s") for i in range(10)] + [(i, "x y z " * 50, "t") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    _, plan = mix_fill.mix_sources(docs)
    plans = {r["_source"]: r for r in plan.collect()}
    mixed = mix_fill.mixed_documents(docs).collect()
    for source, largest in (("s", 11), ("t", 150)):
        taken = sum(len(r["text"].split()) for r in mixed if r["source"] == source)
        assert abs(taken - plans[source]["target"]) <= largest
    again = collections.Counter(mix_fill.mixed_documents(docs.repartition(2)).collect())
    assert again == collections.Counter(mixed)


def test_an_edge_is_narrowed_until_few_rows_share_it(spark, monkeypatch):
    rows = [(i, "a b c", "s") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    whole = collections.Counter(r["doc_id"] for r in mix_fill.mixed_documents(docs).collect())
    monkeypatch.setattr(mix_fill, "FEW_ROWS", 1)
    monkeypatch.setattr(mix_fill, "DIGITS", 1)
    assert collections.Counter(r["doc_id"] for r in mix_fill.mixed_documents(docs).collect()) == whole


def test_many_blocks_find_what_one_block_finds(spark):
    rng = random.Random(6)
    items = [(f"i{k}", " ".join(words(rng, 40))) for k in range(30)] + [("short", "only four words here"), ("none", "")]
    rows = []
    for i in range(60):
        text = words(rng, 80)
        for _ in range(rng.randrange(3)):
            own = items[rng.randrange(30)][1].split()
            at = rng.randrange(25)
            text[rng.randrange(60) : 70] = own[at : at + rng.randrange(8, 16)]
        rows.append((i, " ".join(text)))
    rows += [(100, rows[3][1]), (101, None), (102, "only four words here"), (103, items[5][1])]
    docs = fx.with_clashes(spark.createDataFrame(rows, "doc_id long, text string")).repartition(4)
    bench = spark.createDataFrame(items, "item_id string, text string")
    one = ngram_leaks.find_leaks(docs, bench, keep=["doc_id"]).collect()
    many = ngram_leaks.find_leaks(docs, bench, keep=["doc_id"], block_bytes=20_000).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, many))
    assert {(r["doc_id"], r["_n_words"], r["_n_hit"], tuple(r["_items"])) for r in many} == {
        (i, n, hit, tuple(found)) for i, n, hit, found in brute_leaks(rows, items)}
    clean = ngram_leaks.find_leaks(docs, bench, keep=["doc_id"], block_bytes=20_000, clean_only=True)
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in one if not r["_n_hit"]}


def test_scores_equal_a_plain_forward_pass(spark):
    """Window by window and word by word, with loops, against the batched scorer."""
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxic_gru.train(*toxic_gru.labelled_sample(docs, labels), epochs=2)
    net, sig = model.network.p, lambda x: 1 / (1 + np.exp(-x))
    weights = dict(zip(model.keys.tolist(), model.weights.tolist()))
    texts = [r["text"] for r in docs.orderBy(F.length("text")).limit(12).collect()] + [None, "", "!!", "Ünï cödé wörds " * 30]

    def logit(inputs):
        states = []
        for way in ("f", "b"):
            h, own = np.zeros(toxic_gru.HIDDEN), []
            for x in inputs if way == "f" else inputs[::-1]:
                p, g, k = x @ net["W" + way] + net["c" + way], h @ net["U" + way], toxic_gru.HIDDEN
                z, r = sig(p[:k] + g[:k]), sig(p[k : 2 * k] + g[k : 2 * k])
                h = (1 - z) * np.tanh(p[2 * k :] + r * g[2 * k :]) + z * h
                own.append(h)
            states.append(own if way == "f" else own[::-1])
        states = np.concatenate([np.array(s) for s in states], axis=1)
        heed = np.exp(states @ net["a"] - (states @ net["a"]).max())
        return ((heed / heed.sum())[:, None] * states).sum(0) @ net["o"] + net["q"][0]

    for text, got in zip(texts, model.score(pa.array(texts))):
        s = next(slices(pa.array([text], pa.string()), LOWER))
        at = toxic_gru.Inputs([s])
        words_in = []
        for a, b, h in zip(at.starts, at.ends, at.hashes.tolist()):
            chars = np.mean([net["E"][c] for c in at.codes[a:b]], axis=0)
            words_in.append(np.concatenate(([weights.get(h, 0.0), float(h in weights)], chars)))
        if not words_in:
            assert got == 0
            continue
        last = max(0, -(-(len(words_in) - toxic_gru.T) // toxic_gru.STRIDE))
        best = max(logit(np.array(words_in[k * toxic_gru.STRIDE : k * toxic_gru.STRIDE + toxic_gru.T])) for k in range(last + 1))
        assert got == pytest.approx(sig(best - model.network.shift), abs=1e-4)


def test_only_labelled_rows_are_scored_for_the_threshold(spark):
    rows = spark.range(20_000).select(F.col("id").alias("_of"), F.lit("t").alias("_text"))
    known = spark.range(0, 20_000, 50).select(F.col("id").cast("int").alias("_key"), F.lit(1).alias("_label"))
    model = toxic_gru.ToxicModel(np.zeros(0, np.uint64), np.zeros(0, np.float32), toxic_gru.Network())
    left = {r["_of"] for r in toxic_gru.score_likely(rows, known, model).collect()}
    assert set(range(0, 20_000, 50)) <= left and len(left) < 600
