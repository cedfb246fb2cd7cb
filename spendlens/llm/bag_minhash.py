"""Near-dedup with BagMinHash: weighted-Jaccard signatures from hierarchical Poisson processes.

A document is the multiset of its five-word shingles. Every shingle owns Poisson processes on its weight axis, cut
into dyadic levels (0,1], (1,2], (2,4], ...; a level's process drops points on signature components and on places
inside the level, and a point counts if its place is at most the shingle's weight. A component keeps the earliest
point. Two documents agree in a component with exactly the probability of their weighted Jaccard similarity. A
shingle of weight w costs log w processes, and points later than the last component's arrival are never drawn.

Signatures are banded; documents that share a band are candidates, and candidates are verified on the exact multiset
overlap. Documents with the same words are one node. In a bucket of a band, members are compared with one leader,
not with each other; what is then in one class needs no more comparison. Further leaders follow as long as they settle
buckets. Of the members of different classes, most pairs are ruled out by their signatures without comparing texts.

Pairs are measured in blocks: nodes of one neighbourhood share a block of bounded size, and a task gets the shingles of each
node of two blocks once, however many pairs of theirs it measures. The last, dense step makes its pairs inside the tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.keyed import aggregate_apart
from .shared import discard, written
from .words import ALNUM, LOWER, doc_of, mix, slices, window_hashes

SIZE = 512
BANDS, ROWS = 32, 4  # made of the first 128 components; a pair of similarity 0.8 shares no band once in 20 million
SHINGLE = 5
#: Another round of leaders follows if the last one settled at least this share of the open members.
SETTLED = 0.2
#: Shingles and nodes of a block; a task holds two blocks, and no more pairs than their nodes make.
BLOCK_SHINGLES, BLOCK_NODES = 1 << 20, 2500
PAIR_ROWS = 64  # nodes of a block that meet all of another at a time
#: Four bits are kept of each component. At similarity 0.8 a pair differs in 96 of 512 on average, with a deviation of
#: 8.8; beyond this many, 5.2 deviations away, a pair can only be that similar once in 10 million.
BITS, MAX_DIFFERENT = 4, 142
SLICE_DOCS = 2000

_STEP = np.uint64(0x9E3779B97F4A7C15)
_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def shingles(hashes: np.ndarray, first: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(document, shingle hash); a document of fewer words, but not none, is one shingle."""
    doc, n = doc_of(first), np.diff(first)
    codes = window_hashes(hashes, size)
    whole = np.flatnonzero(doc[: len(codes)] == doc[size - 1 :]) if len(codes) else np.zeros(0, np.int64)
    docs, keys = [doc[whole]], [codes[whole]]
    for short in range(1, size):
        if len(own := np.flatnonzero(n == short)):
            docs.append(own)
            keys.append(window_hashes(hashes, short)[first[:-1][own]])
    return np.concatenate(docs), np.concatenate(keys)


def weighted(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, weight), ordered by document and shingle."""
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    head = np.flatnonzero(np.append(True, (np.diff(doc) != 0) | (key[1:] != key[:-1]))[: len(doc)])
    return doc[head], key[head], np.diff(np.append(head, len(doc)))


def signatures(doc: np.ndarray, key: np.ndarray, weight: np.ndarray, n_docs: int, size: int = SIZE) -> np.ndarray:
    """(documents, size) arrival times; documents without shingles have infinite ones."""
    out = np.full(n_docs * size, np.inf)
    total = np.bincount(doc, weight, n_docs)
    levels = 1 + np.ceil(np.log2(weight)).astype(np.int64)  # of a shingle: (0,1], then (2**(j-1), 2**j]
    of = np.repeat(np.arange(len(doc)), levels)
    level = np.arange(len(of)) - np.repeat(np.cumsum(levels) - levels, levels)
    base = np.where(level > 0, 1 << np.maximum(level - 1, 0), 0)
    width = np.maximum(base, 1)
    seed = mix(key[of] + level.astype(np.uint64) * _STEP)
    owner, cap, rate = doc[of], weight[of], (size * width).astype(float)
    # by then a component has had a point with probability 1 - e**-4 / size; the few documents left go on
    limit = (np.log(size) + 4) / np.maximum(total, 1)
    todo = np.ones(n_docs, bool)
    while True:
        alive = np.flatnonzero(todo[owner])
        time, k = np.zeros(len(owner)), 0
        while len(alive):
            draw = mix(seed[alive] + np.uint64(k * int(_STEP) & 0xFFFFFFFFFFFFFFFF))
            time[alive] -= np.log(((draw >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / rate[alive]
            early = time[alive] < limit[owner[alive]]
            alive, draw = alive[early], draw[early]
            point = mix(draw ^ _STEP)
            place = base[alive] + ((point >> np.uint64(16)) % width[alive].astype(np.uint64)).astype(np.int64)
            hit = place < cap[alive]
            at = owner[alive[hit]] * size + (point[hit] % np.uint64(size)).astype(np.int64)
            np.minimum.at(out, at, time[alive[hit]])
            k += 1
        todo = (total > 0) & np.isinf(out.reshape(n_docs, size)).any(1)
        if not todo.any():
            return out.reshape(n_docs, size)
        limit = np.where(todo, limit * 2, limit)


def bands(signature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band hashes (documents, BANDS), and ``BITS`` bits per component as planes of 64-bit words (documents, BITS * SIZE / 64)."""
    codes = mix(signature.view(np.uint64))
    factors = mix(np.arange(1, ROWS + 1, dtype=np.uint64) * _STEP) | np.uint64(1)
    banded = (codes[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS) * factors).sum(2, dtype=np.uint64)
    planes = [np.packbits(((codes >> np.uint64(b)) & np.uint64(1)).astype(np.uint8), axis=1).view(np.int64) for b in range(BITS)]
    return mix(banded + np.arange(BANDS, dtype=np.uint64) * _STEP).view(np.int64), np.concatenate(planes, 1)


def text_digests(hashes: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit digests of each document's word sequence."""
    out, n = [], np.diff(first)
    for base in _BASES:
        powers = np.full(len(hashes) + 1, base, np.uint64)
        powers[0] = 1
        back = np.full(len(hashes) + 1, pow(base, -1, 1 << 64), np.uint64)
        back[0] = 1
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(hashes ^ np.uint64(base)) * np.cumprod(powers)[:-1])))
        whole = (sums[first[1:]] - sums[first[:-1]]) * np.cumprod(back)[first[:-1]]
        out.append(mix(whole ^ n.astype(np.uint64)).view(np.int64))
    return out


def _lists(values: np.ndarray) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, width, dtype=np.int32)), pa.array(values.ravel()))


def _prints(batches):
    for batch in batches:
        for s in slices(batch.column("text"), LOWER, max_docs=SLICE_DOCS):
            starts, ends, first = s.spans(ALNUM[s.data])
            hashes = s.hashes(starts, ends)
            banded, sketch = bands(signatures(*weighted(*shingles(hashes, first)), s.n_docs))
            d1, d2 = text_digests(hashes, first)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).slice(s.first_doc, s.n_docs) for c in ("doc_id", "row")), pa.array(np.diff(first)), pa.array(d1),
                 pa.array(d2), _lists(banded), _lists(sketch)],
                names=["doc_id", "row", "n_words", "d1", "d2", "bands", "sketch"])


def _multisets(batches):
    """The n-th equal shingle of a document gets a code of its own, so overlaps of sets are overlaps of multisets."""
    for batch in batches:
        for s in slices(batch.column("text"), LOWER):
            starts, ends, first = s.spans(ALNUM[s.data])
            doc, key = shingles(s.hashes(starts, ends), first)
            order = np.lexsort((key, doc))
            doc, key = doc[order], key[order]
            place = np.arange(len(doc))
            head = np.append(True, (np.diff(doc) != 0) | (key[1:] != key[:-1]))[: len(doc)]
            nth = place - np.maximum.accumulate(np.where(head, place, 0))
            codes = np.where(nth > 0, mix(key + nth.astype(np.uint64) * _STEP), key).view(np.int64)
            codes = codes[np.lexsort((codes, doc))]
            edges = np.searchsorted(doc, np.arange(s.n_docs + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("node").slice(s.first_doc, s.n_docs), pa.ListArray.from_arrays(pa.array(edges), pa.array(codes))],
                names=["node", "codes"])


def connected_classes(edges: DataFrame) -> DataFrame:
    """(node, class): the smallest node of the component, for every node of ``edges`` (a, b).

    Each round takes the smallest class among the neighbours and then follows classes to their own class, so chains
    halve. Rounds are written; only the number of changes comes to the driver."""
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "near-edges")
    classes = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                      .select("node", F.least("node", "m").alias("class")), "near-classes")
    while True:
        near = both.join(classes, F.col("b") == F.col("node")).groupBy(F.col("a").alias("_n")).agg(F.min("class").alias("m"))
        lower = written(classes.join(near, F.col("node") == F.col("_n"))
                        .select("node", F.col("class").alias("old"), F.least("class", "m").alias("class")), "near-classes")
        up = lower.select(F.col("node").alias("_n"), F.col("class").alias("m"))
        after = written(lower.join(up, F.col("class") == F.col("_n")).select("node", "old", F.least("class", "m").alias("class")), "near-classes")
        changed = after.filter(F.col("old") != F.col("class")).count()
        discard(classes, lower)
        if not changed:
            discard(both)
            return after
        classes = after


def _overlaps(pairs: pa.Table, sent: pa.Table) -> pa.Table:
    """(a, b, overlap, total) of the pairs of two blocks, from the sorted shingle codes of their nodes."""
    nodes, lists = sent.column("node").to_numpy(), sent.column("codes").combine_chunks()
    values = lists.flatten().to_numpy()
    edges = np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))).astype(np.int64)
    order = np.argsort(nodes)
    a, b = (pairs.column(c).to_numpy() for c in "ab")
    by_a = np.argsort(a, kind="stable")
    a, b = a[by_a], b[by_a]
    at_a, at_b = (order[np.searchsorted(nodes[order], x)] for x in (a, b))
    overlap, size = np.zeros(len(a), np.int64), np.diff(edges)
    heads = np.flatnonzero(np.append(True, a[1:] != a[:-1])[: len(a)])
    for lo, hi in zip(heads, np.append(heads[1:], len(a))):
        own, others = values[edges[at_a[lo]] : edges[at_a[lo] + 1]], at_b[lo:hi]
        starts = np.append(0, np.cumsum(size[others]))
        codes = values[np.arange(starts[-1]) + np.repeat(edges[others] - starts[:-1], size[others])]
        place = np.minimum(np.searchsorted(own, codes), max(len(own) - 1, 0))
        hits = np.append(0, np.cumsum(own[place] == codes)) if len(own) else np.zeros(len(codes) + 1, np.int64)
        overlap[lo:hi] = hits[starts[1:]] - hits[starts[:-1]]
    return pa.table({"a": a, "b": b, "overlap": overlap, "total": size[at_a] + size[at_b] - overlap})


def _measured(pairs: DataFrame, blocks: DataFrame, multisets: DataFrame) -> DataFrame:
    """(a, b, overlap, total): shingles in common and in either, as multisets. The shingles of a node go once to each block
    its pairs lead to, not once to each pair."""
    first = blocks.select(F.col("node").alias("_a"), F.col("block").alias("_u"))
    second = blocks.select(F.col("node").alias("_b"), F.col("block").alias("_v"))
    placed = written(
        pairs.distinct().join(first, F.col("a") == F.col("_a")).join(second, F.col("b") == F.col("_b"))
        .select("a", "b", F.least("_u", "_v").alias("u"), F.greatest("_u", "_v").alias("v")), "near-pairs")
    needed = placed.select(F.col("u").alias("_p"), F.col("v").alias("_q"), F.explode(F.array("a", "b")).alias("_needed")).distinct()
    sent = needed.join(multisets, F.col("_needed") == F.col("node")).select("_p", "_q", "node", "codes")
    schema = "a long, b long, overlap long, total long"
    out = written(placed.groupBy("u", "v").cogroup(sent.groupBy("_p", "_q")).applyInArrow(_overlaps, schema), "near-measured")
    discard(placed)
    return out


def _block_links(share: tuple[int, int]):
    """Links between nodes of different classes in two blocks (or in one): pairs that share a bucket and whose sketches do not rule
    them out are decided by exact overlap inside the task, and only links leave it."""

    def run(rows: pa.Table) -> pa.Table:
        node, block, own = (rows.column(c).to_numpy() for c in ("node", "block", "class"))
        bucket = rows.column("bands").combine_chunks().flatten().to_numpy().reshape(len(node), BANDS)
        planes = rows.column("sketch").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(node), BITS, SIZE // 64)
        u, v = rows.column("u")[0].as_py(), rows.column("v")[0].as_py()
        left, right = np.flatnonzero(block == u), np.flatnonzero(block == v)
        found_a, found_b = [], []
        for lo in range(0, len(left), PAIR_ROWS):
            some = left[lo : lo + PAIR_ROWS]
            met = (bucket[some][:, None, :] == bucket[right][None, :, :]).any(2) & (own[some][:, None] != own[right][None, :])
            if u == v:
                met &= some[:, None] < right[None, :]
            i, j = np.nonzero(met)
            i, j = some[i], right[j]
            differ = np.bitwise_count(np.bitwise_or.reduce(planes[i] ^ planes[j], axis=1)).sum(1)
            near = differ <= MAX_DIFFERENT
            if near.any():
                pairs = _overlaps(pa.table({"a": node[i[near]], "b": node[j[near]]}), rows)
                overlap, total = pairs.column("overlap").to_numpy(), pairs.column("total").to_numpy()
                linked = overlap * share[1] >= total * share[0]
                found_a.append(pairs.column("a").to_numpy()[linked])
                found_b.append(pairs.column("b").to_numpy()[linked])
        joined = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return pa.table({"a": joined(found_a), "b": joined(found_b)})

    return run


def _decided(opened: DataFrame, blocks: DataFrame, nodes: DataFrame, multisets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """(a, b): the links among ``opened`` (bucket, node, class), nodes of buckets that hold several classes. A node goes once to each
    block where a node of another class shares a bucket with it, its own among them; pairs are never rows of a table."""
    placed = written(opened.join(blocks.select(F.col("node").alias("_m"), "block"), F.col("node") == F.col("_m"))
                     .select("bucket", "node", "class", "block"), "near-placed")
    held = written(placed.groupBy("bucket", "block").agg(F.min("class").alias("lo"), F.max("class").alias("hi"))
                   .groupBy("bucket").agg(F.collect_list(F.struct("block", "lo", "hi")).alias("held")), "near-open-blocks")
    others = F.transform(F.filter("held", lambda x: (x["lo"] != F.col("class")) | (x["hi"] != F.col("class"))), lambda x: x["block"])
    led = placed.join(held, "bucket").select("node", "class", "block", others.alias("others")) \
        .groupBy("node", "class", "block").agg(F.array_distinct(F.flatten(F.collect_list("others"))).alias("others"))
    details = led.join(nodes.select(F.col("node").alias("_n"), "bands", "sketch"), F.col("node") == F.col("_n")) \
        .join(multisets.select(F.col("node").alias("_c"), "codes"), F.col("node") == F.col("_c"))
    sent = details.select("node", "class", "block", "bands", "sketch", "codes", F.explode("others").alias("_at")) \
        .withColumns({"u": F.least("block", "_at"), "v": F.greatest("block", "_at")}).drop("_at")
    out = written(sent.groupBy("u", "v").applyInArrow(_block_links(share), "a long, b long"), "near-decided")
    discard(placed, held)
    return out


def _neighbourhoods(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, block): nodes whose smallest leader is the same lie in one block, or in several if they are many or long."""
    homes = written(members.groupBy("node").agg(F.min("leader").alias("home")).join(
        nodes.select(F.col("node").alias("_m"), F.greatest(F.col("n_words") - (SHINGLE - 1), F.lit(1)).alias("n")), F.col("node") == F.col("_m"))
        .select("node", "home", "n"), "near-homes")
    parts = aggregate_apart(homes, ["home"], F.greatest(
        F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_NODES)).alias("parts"))
    blocks = written(homes.join(parts, "home").select("node", F.xxhash64("home", F.pmod(F.xxhash64("node"), F.col("parts"))).alias("block")), "near-blocks")
    discard(homes)
    return blocks


def _row_digest(key: str, text: str) -> Column:
    """Names a row by its key and its text."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.md5(F.col(key).cast("string")), F.lit("null")), F.coalesce(F.col(text), F.lit("")))))


def _classed(docs: DataFrame, key: str, text: str, share: tuple[int, int]) -> DataFrame:
    """(doc_id, row, smallest, kept, ...) of every row: its digest, and for classes of more than one row the smallest key of the class and the
    digest of the row that stands for it, else nulls."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), _row_digest(key, text).alias("row"))
    prints = written(rows.mapInArrow(_prints, f"doc_id {kind}, row binary, n_words long, d1 long, d2 long, bands array<long>, sketch array<long>"), "near-prints")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    nodes = written(prints.filter("n_words > 0").groupBy("d1", "d2").agg(
        F.min(first).alias("first"), F.count("*").alias("rows"), F.min("n_words").alias("n_words"), F.any_value("bands").alias("bands"),
        F.any_value("sketch").alias("sketch")).withColumn("node", F.monotonically_increasing_id()), "near-nodes")  # numbered as written
    banded = nodes.select("node", F.posexplode("bands").alias("band", "bucket"))
    shared = written(banded.groupBy("bucket").agg(F.min("node").alias("leader"), F.count("*").alias("n")).filter("n > 1").drop("n"), "near-buckets")
    members = written(banded.join(shared, "bucket"), "near-members")
    discard(shared)
    blocks = _neighbourhoods(members, nodes)
    named = blocks.join(nodes.select(F.col("node").alias("_m"), "first.row"), F.col("node") == F.col("_m")).select("node", F.col("row").alias("_row"))
    multisets = written(
        rows.join(named, F.col("row") == F.col("_row")).select("row", "node", "text").dropDuplicates(["row"])
        .select("node", "text").mapInArrow(_multisets, "node long, codes array<long>"), "near-multisets")

    def near(measured: DataFrame) -> DataFrame:
        return measured.filter(F.col("overlap") * share[1] >= F.col("total") * share[0]).select("a", "b")

    led = _measured(members.filter("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")), blocks, multisets)
    edges = written(near(led), "near-links")
    far = led.select(F.col("a").alias("_a"), F.col("b").alias("_b"), (1 - F.col("overlap") / F.col("total")).alias("far"))  # from leaders
    # a node that is close to the leaders it has met lies in the middle of its group
    middle = written(
        far.select(F.col("_a").alias("_c"), "far").unionByName(far.select(F.col("_b").alias("_c"), "far"))
        .groupBy("_c").agg(F.avg("far").alias("mean_far")), "near-middle")
    classes, before = connected_classes(edges), None
    while True:
        held = written(
            members.join(classes.select(F.col("node").alias("_n"), "class"), F.col("node") == F.col("_n"), "left")
            .join(middle, F.col("node") == F.col("_c"), "left")
            .select("bucket", "node", "mean_far", F.coalesce("class", "node").alias("class")), "near-held")
        still = written(held.groupBy("bucket").agg(
            F.min("class").alias("lo"), F.max("class").alias("hi"), F.count("*").alias("n"),
            F.min(F.struct("mean_far", "node", "class")).alias("star")).filter("lo <> hi"), "near-open")
        n_open = still.agg(F.sum("n")).first()[0] or 0
        leaders = before is None or n_open <= (1 - SETTLED) * before
        if n_open:
            mixed = held.join(still.select("bucket", "star"), "bucket")
            if leaders:  # the middle of each bucket that holds several classes as another leader
                pairs = mixed.filter(F.col("class") != F.col("star.class")).select(F.col("star.node").alias("a"), F.col("node").alias("b"))
                measured = _measured(pairs, blocks, multisets)
                found = near(measured)
            else:  # what is left: pairs of different classes that the signatures do not rule out
                found = measured = _decided(mixed.select("bucket", "node", "class"), blocks, nodes, multisets, share)
            after = written(edges.unionByName(found), "near-links")
            discard(measured, edges, classes)
            edges = after
            classes = connected_classes(edges)
        discard(held, still)
        if not n_open or not leaders:
            break
        before = n_open
    discard(members, blocks, multisets, led, middle, edges)
    grouped = nodes.join(classes.select(F.col("node").alias("_n"), "class"), F.col("node") == F.col("_n"), "left") \
        .select("node", "d1", "d2", "first", "rows", F.coalesce("class", "node").alias("class"))
    whole = aggregate_apart(grouped, ["class"], F.min("first").alias("best"), F.sum("rows").alias("n")).filter("n > 1")
    groups = written(grouped.join(whole, "class").select(
        F.col("d1").alias("_d1"), F.col("d2").alias("_d2"), F.col("best.doc_id").alias("smallest"), F.col("best.row").alias("kept")), "near-groups")
    discard(nodes, classes)
    thin = written(prints.select("doc_id", "row", "n_words", "d1", "d2"), "near-rows")
    discard(prints)
    mine = (F.col("d1") == F.col("_d1")) & (F.col("d2") == F.col("_d2")) & (F.col("n_words") > 0)
    return thin.join(groups, mine, "left")


def near_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", share: tuple[int, int] = (4, 5)) -> DataFrame:
    """One row per row of ``docs``: key and ``class_id``, the smallest key of its group of near-duplicates.

    Two documents are near-duplicates if the weighted Jaccard similarity of their five-word shingles (A-Z lower-cased,
    words of letters, digits and characters beyond ASCII) is at least 4/5; groups are closed under that.

    * null and empty texts, and texts without words, are alone, each its own class
    * a text of one to four words is one shingle; texts with the same words are always one class
    * whole texts are used, however long; ties do not exist, a class is named by its smallest key
    * repeated rows are copies; a key that stands on different texts belongs to the class of each, row by row; rows with a null key
      join groups by their text, and a group of null keys only has a null class
    * an empty table gives no rows; other columns play no part, whatever their names
    """
    out = _classed(docs, key, text, share)
    return out.select(F.col("doc_id").alias(key), F.coalesce("smallest", "doc_id").alias("class_id"))


def keep_one_per_class(docs: DataFrame, key: str = "doc_id", text: str = "text", share: tuple[int, int] = (4, 5)) -> DataFrame:
    """The rows of ``docs``, all columns, less those that have a near-duplicate among the rows that stay.

    Of each class the row with the smallest key stays (null keys last); of rows with the same key and text, one. Rows
    without words stay, each key once, those with a null key all."""
    gone = _classed(docs, key, text, share).filter(F.col("kept").isNotNull() & (F.col("row") != F.col("kept"))).select(F.col("row").alias("_gone"))
    named = docs.withColumn("_row", _row_digest(key, text))
    alone = F.when(F.col(key).isNull() & ~F.coalesce(F.col(text).rlike(r"[0-9A-Za-z]|[^\x00-\x7F]"), F.lit(False)), F.monotonically_increasing_id())
    kept = named.join(gone.distinct(), F.col("_row") == F.col("_gone"), "left_anti").withColumn("_alone", alone)
    return kept.dropDuplicates(["_row", "_alone"]).select(*docs.columns)
