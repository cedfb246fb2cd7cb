"""op10: the last step sends a node only to blocks that hold another class of one of its buckets."""

import random

import pyarrow as pa
import pytest

from spendlens.llm import bag_minhash

LARGE, SMALL = 200, 30


@pytest.fixture(scope="module")
def crowd(spark):
    """Bucket 0: a block of 200 nodes of one class, node 1000 of another class in the same block, node 1001 of the first class in a block of
    its own. Buckets 1 to 30: one of the 200, and a node in a small block, every second time with the same text."""
    small = [(1 + k, k, 2000 + k) for k in range(SMALL)]
    opened = [(0, i, 0) for i in range(LARGE)] + [(0, 1000, 1000), (0, 1001, 0)] + [(b, k, 0) for b, k, _ in small] + [(b, n, n) for b, _, n in small]
    blocks = [(i, 0) for i in range(LARGE)] + [(1000, 0), (1001, 99)] + [(n, b) for b, _, n in small]
    bands = {n: [-1 - 100 * n - i for i in range(bag_minhash.BANDS)] for n, _ in blocks}  # hashes of no other node
    for bucket, node, _ in opened:
        bands[node][bucket] = bucket
    sketch = [0] * (bag_minhash.BITS * bag_minhash.SIZE // 64)
    text = {n: n - 2000 if n >= 2000 and n % 2 == 0 else n for n in bands}
    codes = [(n, sorted(random.Random(t).sample(range(10_000), 50))) for n, t in text.items()]
    return (spark.createDataFrame(opened, "bucket long, node long, class long"), spark.createDataFrame(blocks, "node long, block long"),
            spark.createDataFrame([(n, b, sketch) for n, b in bands.items()], "node long, bands array<long>, sketch array<long>"),
            spark.createDataFrame(codes, "node long, codes array<long>"))


def test_links_between_blocks(crowd):
    got = {tuple(sorted((r["a"], r["b"]))) for r in bag_minhash._decided(*crowd, (4, 5)).collect()}
    assert got == {(k, 2000 + k) for k in range(0, SMALL, 2)}


def test_a_node_goes_to_blocks_with_another_class_of_its_buckets(crowd, monkeypatch):
    monkeypatch.setattr(bag_minhash, "_block_links", lambda share: lambda rows: pa.table({"a": [rows.num_rows], "b": [0]}))
    # a small block meets one node, node 1001 meets node 1000, and all but node 1001 meet in the large block
    assert sorted(r["a"] for r in bag_minhash._decided(*crowd, (4, 5)).collect()) == [2] * (SMALL + 1) + [LARGE + 1]
