"""Toxicity: a bidirectional gated recurrent network with attention pooling over word and character inputs.

A text's words are cut into overlapping windows. Each word enters as a word input (how much more often it
stands in toxic than in other labelled documents) and a character input (the mean of learned vectors of
its character trigrams). Two gated recurrent passes, one in each direction, read a window; attention pools their
states into one score. A document's score is that of its most toxic window. The network is trained in numpy on a
bounded sample of labelled rows, each step on the window that decides a document, and applied to whole texts. The score
from which a text is toxic is set on all labelled rows outside the held-out fold, whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import ALNUM, LOWER, doc_of, slices

T, STRIDE = 32, 24  # words of a window, and from one window's start to the next
HIDDEN = 6
CHARS, CHAR_DIM = 4096, 4  # hashed trigrams, size of their vectors
WORD_DIM = 2
SCORE_BYTES = 1 << 18
BINS, BIN_SPAN = 64, 32  # bins per unit of logit, and the largest logit told apart
KEY_BITS = 1 << 24  # marks of labelled keys, 2 MB
PIECES = 10  # passages that stand for a long text in training


def trigram_codes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Hashed trigram centred on each byte; nothing stands before or behind a document."""
    x = data.astype(np.uint32)
    before, after = np.roll(x, 1), np.roll(x, -1)
    if len(x):
        before[offsets[:-1][offsets[:-1] < len(x)]] = 0
        after[offsets[1:][offsets[1:] > 0] - 1] = 0
    return ((before * np.uint32(7919) + x * np.uint32(104729) + after * np.uint32(1299709)) * np.uint32(2654435761)) >> np.uint32(20)


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end word of every window, and its document; a document with words has one at least."""
    n = np.diff(first)
    many = np.where(n > 0, np.maximum(1, 1 - (T - n) // STRIDE), 0)
    doc = np.repeat(np.arange(len(n)), many)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
    start = first[:-1][doc] + nth * STRIDE
    return start, np.minimum(start + T, first[1:][doc]), doc


class Inputs:
    """What the network needs of the words of some documents."""

    def __init__(self, parts):
        starts, ends, hashes, codes, first, at = [], [], [], [], [np.zeros(1, np.int64)], 0
        for s in parts:
            inside = ALNUM[s.data]
            a, b, f = s.spans(inside)
            hashes.append(s.hashes(a, b))
            starts.append((a + at).astype(np.int32))
            ends.append((b + at).astype(np.int32))
            first.append(f[1:] + first[-1][-1])
            codes.append(trigram_codes(np.where(inside, s.data, 0), s.offsets).astype(np.uint16))
            at += len(s.data)
        self.starts, self.ends, self.hashes, self.codes, self.first = map(np.concatenate, (starts, ends, hashes, codes, first))
        self.n = len(self.starts)

    def character_means(self, vectors: np.ndarray) -> np.ndarray:
        if not self.n:
            return np.zeros((0, vectors.shape[1]), np.float32)
        total = np.empty((self.n, vectors.shape[1]), np.float32)
        edges = np.column_stack((self.starts, self.ends)).ravel()
        closed = edges[-1] == len(self.codes)
        for k in range(vectors.shape[1]):
            flat = vectors[:, k][self.codes]
            total[:, k] = np.add.reduceat(flat, edges[:-1] if closed else edges)[::2]
        return total / (self.ends - self.starts)[:, None].astype(np.float32)


def word_inputs(hashes: np.ndarray, keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
    out = np.zeros((len(hashes), WORD_DIM), np.float32)
    if len(keys):
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        known = keys[at] == hashes
        out[:, 0] = np.where(known, weights[at], 0)
        out[:, 1] = known
    return out


def word_weights(pairs: np.ndarray, labels: np.ndarray, least: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Log ratio of the shares of toxic and other documents that hold a word, halved and shrunk for rare words.

    ``pairs``: (word hash, document) once each; words of fewer than ``least`` documents are left out."""
    hashes, doc = pairs
    keys, back, count = np.unique(hashes, return_inverse=True, return_counts=True)
    toxic = np.bincount(back, labels[doc.astype(np.int64)], len(keys))
    p, n = max(labels.sum(), 1), max(len(labels) - labels.sum(), 1)
    weight = np.log((toxic + 0.5) / (p + 1)) - np.log((count - toxic + 0.5) / (n + 1))
    weight *= 0.5 * count / (count + 4.0)
    often = count >= least
    return keys[often], weight[often].astype(np.float32)


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


class Network:
    """Parameters, forward pass and gradients."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        self.p = {"E": rng.normal(0, 0.05, (CHARS, CHAR_DIM))}
        for way in "fb":
            self.p["W" + way] = rng.normal(0, 0.4, (d, 3 * h))
            self.p["U" + way] = rng.normal(0, 0.3, (h, 3 * h))
            self.p["c" + way] = np.zeros(3 * h)
        self.p |= {"a": rng.normal(0, 0.3, 2 * h), "o": rng.normal(0, 0.5, 2 * h), "q": np.full(1, -1.0)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.shift = 0.0  # logit from which a document counts as toxic

    def _pass(self, way, proj, at, mask, keep):
        u, steps = self.p["U" + way], range(T) if way == "f" else range(T - 1, -1, -1)
        h = np.zeros((at.shape[1], HIDDEN), np.float32)
        states, memo = np.empty((T, at.shape[1], HIDDEN), np.float32), [None] * T
        for t in steps:
            x, g = proj[at[t]], h @ u
            zr = _sigmoid(x[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            new = np.tanh(x[:, 2 * HIDDEN :] + r * g[:, 2 * HIDDEN :])
            if keep:
                memo[t] = (h, z, r, new, g[:, 2 * HIDDEN :])
            h = np.where(mask[t][:, None], new + z * (h - new), h)
            states[t] = h
        return states, memo

    def forward(self, x, start, end, keep=False):
        """Logit of each window. ``x``: inputs per word, one row of zeros behind the last."""
        at = start + np.arange(T)[:, None]
        mask = at < end
        at = np.where(mask, at, len(x) - 1)
        both = [self._pass(way, x @ self.p["W" + way] + self.p["c" + way], at, mask, keep) for way in "fb"]
        states = np.concatenate([b[0] for b in both], axis=2)
        heed = np.where(mask, states @ self.p["a"], np.float32(-1e9))
        heed = np.exp(heed - heed.max(0))
        heed /= heed.sum(0)
        pooled = (heed[:, :, None] * states).sum(0)
        logit = pooled @ self.p["o"] + self.p["q"]
        return (logit, at, mask, states, heed, pooled, [b[1] for b in both]) if keep else logit

    def gradients(self, x, start, end, labels, weight):
        logit, at, mask, states, heed, pooled, memos = self.forward(x, start, end, keep=True)
        out = {k: np.zeros_like(v) for k, v in self.p.items() if k != "E"}
        d = ((_sigmoid(logit) - labels) * weight / len(labels)).astype(np.float32)
        out["o"], out["q"] = pooled.T @ d, d.sum(keepdims=True)
        dpool = d[:, None] * self.p["o"]
        along = (states * dpool).sum(2)
        dheed = heed * (along - (heed * along).sum(0))
        out["a"] = (states * dheed[:, :, None]).sum((0, 1))
        dstates = heed[:, :, None] * dpool + dheed[:, :, None] * self.p["a"]
        dx = np.zeros_like(x)
        for i, way in enumerate("fb"):
            w, u, dh = self.p["W" + way], self.p["U" + way], np.zeros((at.shape[1], HIDDEN), np.float32)
            for t in range(T - 1, -1, -1) if way == "f" else range(T):
                old, z, r, new, gn = memos[i][t]
                dh = dh + dstates[t][:, i * HIDDEN : (i + 1) * HIDDEN]
                on = mask[t][:, None]
                do = np.where(on, dh, 0)
                dn = do * (1 - z) * (1 - new * new)
                dz = do * (old - new) * z * (1 - z)
                dr = dn * gn * r * (1 - r)
                gates, inner = np.concatenate((dz, dr, dn), 1), np.concatenate((dz, dr, dn * r), 1)
                out["U" + way] += old.T @ inner
                out["W" + way] += x[at[t]].T @ gates
                out["c" + way] += gates.sum(0)
                np.add.at(dx, at[t], gates @ w.T)
                dh = np.where(on, do * z + inner @ u.T, dh)
        dx[-1] = 0
        return out, dx, logit

    def inputs(self, words: Inputs, keys, weights):
        x = np.concatenate((word_inputs(words.hashes, keys, weights), words.character_means(self.p["E"])), 1)
        return np.concatenate((x, np.zeros((1, x.shape[1]), np.float32)))


class ToxicModel:
    """Word weights and network; ``score(texts)`` gives one number in 0..1 per whole text."""

    def __init__(self, keys, weights, network):
        self.keys, self.weights, self.network = keys, weights, network

    def logits(self, words: Inputs) -> np.ndarray:
        """Largest window logit per document; -inf without words."""
        out = np.full(len(words.first) - 1, -np.inf)
        if words.n:
            start, end, doc = windows(words.first)
            x = self.network.inputs(words, self.keys, self.weights)
            best = np.concatenate([self.network.forward(x, start[i : i + 8192], end[i : i + 8192])
                                   for i in range(0, len(start), 8192)])
            heads = np.flatnonzero(np.diff(doc, prepend=-1))
            out[doc[heads]] = np.maximum.reduceat(best, heads)
        return out - self.network.shift

    def score(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts))
        for s in slices(texts, LOWER, SCORE_BYTES):
            logits = self.logits(Inputs([s]))
            out[s.first_doc : s.first_doc + s.n_docs] = np.where(np.isneginf(logits), 0.0, 1 / (1 + np.exp(-np.clip(logits, -500, 500))))
        return out


def _adam(p, g, state, rate):
    m, v, n = state.get("m", 0), state.get("v", 0), state.get("n", 0) + 1
    m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
    state |= {"m": m, "v": v, "n": n}
    return (p - rate * (m / (1 - 0.9**n)) / (np.sqrt(v / (1 - 0.999**n)) + 1e-8)).astype(np.float32)


def train(texts: list[str], toxic: np.ndarray, epochs: int = 6, batch: int = 256, folds: int = 4, seed: int = 7) -> ToxicModel:
    """Fit to whole labelled texts. Word weights used in training come from the other folds' documents, so that the
    network learns to rely on words as far as they hold for unseen documents."""
    return _train(texts, toxic, epochs, batch, folds, seed)[0]


def _train(texts, toxic, epochs=6, batch=256, folds=4, seed=7) -> tuple[ToxicModel, np.ndarray, np.ndarray]:
    """The model, and the deciding logits of the texts with words, as of unseen documents, and their numbers."""
    rng = np.random.default_rng(seed)
    toxic = np.asarray(toxic, np.float32)
    network = Network(seed)
    if not len(texts) or toxic.min() == toxic.max():  # nothing to learn from: never toxic
        network.shift = 1e3
        return ToxicModel(np.zeros(0, np.uint64), np.zeros(0, np.float32), network), np.zeros(0), np.zeros(0, np.int64)
    words = Inputs(slices(pa.array(texts), LOWER))
    n_texts = len(texts)
    del texts  # the driver holds one form of the sample at a time
    doc = doc_of(words.first).astype(np.int32)
    order = np.lexsort((doc, words.hashes))
    pairs = np.vstack((words.hashes[order], doc[order].astype(np.uint64)))
    del order
    pairs = pairs[:, np.append(True, (pairs[0, 1:] != pairs[0, :-1]) | (pairs[1, 1:] != pairs[1, :-1]))[: pairs.shape[1]]]
    fold = rng.permutation(n_texts) % folds
    x_words = np.zeros((words.n, WORD_DIM), np.float32)
    for k in range(folds):
        other = fold[pairs[1].astype(np.int64)] != k
        number = np.cumsum(fold != k) - 1
        known = np.vstack((pairs[0][other], number[pairs[1][other].astype(np.int64)].astype(np.uint64)))
        mine = fold[doc] == k
        x_words[mine] = word_inputs(words.hashes[mine], *word_weights(known, toxic[fold != k]))
        del other, number, known, mine
    weights = word_weights(pairs, toxic)
    del pairs, doc
    words.hashes = None

    def inputs():
        x = np.concatenate((x_words, words.character_means(network.p["E"])), 1)
        return np.concatenate((x, np.zeros((1, x.shape[1]), np.float32)))

    start, end, of = windows(words.first)
    heads = np.flatnonzero(np.diff(of, prepend=-1))
    present = of[heads]
    sums = np.concatenate(([0], np.cumsum(np.maximum(x_words[:, 0], 0))))
    worth = sums[end] - sums[start]  # before the network knows anything, the words' weights point to the window
    state: dict = {k: {} for k in network.p}
    positive = toxic[present].mean()
    for epoch in range(epochs):
        top = np.lexsort((-worth, of))[heads]  # the deciding window of each document
        for _ in range(3):
            order = rng.permutation(len(top))
            for i in range(0, len(order), batch):
                pick = top[order[i : i + batch]]
                y = toxic[of[pick]]
                # only the picked windows' words take part
                at = start[pick][:, None] + np.arange(T)
                own = np.unique(at[at < end[pick][:, None]])
                lo = np.searchsorted(own, start[pick])
                hi = np.searchsorted(own, end[pick] - 1) + 1
                part = Inputs.__new__(Inputs)
                part.starts, part.ends, part.codes, part.n = words.starts[own], words.ends[own], words.codes, len(own)
                chars = _sparse_means(part, network.p["E"])
                x = np.concatenate((np.concatenate((x_words[own], chars), 1), np.zeros((1, WORD_DIM + CHAR_DIM), np.float32)))
                grads, dx, _ = network.gradients(x, lo, hi, y, np.where(y > 0, 0.5 / positive, 0.5 / (1 - positive)))
                grads["E"] = _spread(part, dx[:-1, WORD_DIM:])
                for k, g in grads.items():
                    network.p[k] = _adam(network.p[k], np.clip(g, -1, 1), state[k], 0.02 if k != "E" else 0.003)
        x = inputs()
        worth = np.concatenate([network.forward(x, start[i : i + 8192], end[i : i + 8192]) for i in range(0, len(start), 8192)])
    decided = np.maximum.reduceat(worth, heads)
    network.shift = _best_cut(decided, toxic[present])
    return ToxicModel(*weights, network), decided, present


def _flat(part) -> tuple[np.ndarray, np.ndarray]:
    size = part.ends - part.starts
    word = np.repeat(np.arange(part.n), size)
    byte = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(part.starts, size)
    return word, part.codes[byte]


def _sparse_means(part, vectors):
    word, codes = _flat(part)
    size = (part.ends - part.starts).astype(np.float32)
    return np.column_stack([np.bincount(word, vectors[codes, k], part.n) / size for k in range(CHAR_DIM)]).astype(np.float32)


def _spread(part, grad):
    word, codes = _flat(part)
    share = grad / (part.ends - part.starts)[:, None]
    return np.column_stack([np.bincount(codes, share[word, k], CHARS) for k in range(CHAR_DIM)]).astype(np.float32)


def _best_cut(logits: np.ndarray, labels: np.ndarray) -> float:
    """Threshold of the best F1, in the middle between the rows on either side."""
    order = np.argsort(-logits, kind="stable")
    right = np.cumsum(labels[order])
    f1 = 2 * right / (np.arange(1, len(order) + 1) + labels.sum())
    last = np.append(np.diff(logits[order]) != 0, True)  # equal logits stay on one side
    at = int(np.argmax(np.where(last, f1, -1)))
    here = logits[order][at]
    return float(here - 1.0 if at + 1 == len(order) else (here + logits[order][at + 1]) / 2)


def _known_labels(labels: DataFrame, key: str, label: str, held_out_of: int) -> DataFrame:
    name = F.col(key).cast("string")
    return (
        labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & (F.crc32(name.cast("binary")) % held_out_of != 0))
        .groupBy(F.col(key).alias("_key")).agg(F.max(label).alias("_label"))
    )


def _sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, max_rows: int, max_chars: int,
            held_out_of: int) -> list:
    """Rows (_key, _label, _text, _whole) of the training sample, by key."""
    spark, room = docs.sparkSession, max_rows * max_chars
    rows = docs.select(F.col(key).alias("_of"), F.col(text).alias("_text")).filter(F.col("_text").isNotNull())
    sizes = rows.select("_of", F.length("_text").alias("_n")).join(_known_labels(labels, key, label, held_out_of), F.col("_of") == F.col("_key")) \
        .groupBy("_key", "_label").agg(F.max("_n").alias("_n")).orderBy(F.xxhash64("_key"), "_key").limit(max_rows)
    chosen = []
    for k, y, n in sizes.collect():
        size = n if y > 0 else min(n, max_chars)
        if size <= room:
            chosen.append((k, y))
            room -= size
    if not chosen:
        return []
    ids = spark.createDataFrame(chosen, sizes.drop("_n").schema)
    size, n = max(1, max_chars // PIECES), F.length("_text")
    pieces = [F.substring("_text", (F.lit(1) + F.floor((n - size) * i / (PIECES - 1))).cast("int"), F.lit(size)) for i in range(PIECES)]
    whole = (F.col("_label") > 0) | (n <= max_chars)
    found = (
        rows.join(F.broadcast(ids), F.col("_of") == F.col("_key"))  # at most max_rows rows
        .select("_key", "_label", F.when(whole, F.col("_text")).otherwise(F.concat_ws(" ", *pieces)).alias("_text"), whole.alias("_whole"))
        .groupBy("_key", "_label").agg(F.min(F.struct("_text", "_whole")).alias("_one")).select("_key", "_label", "_one.*").collect()
    )
    return sorted(found, key=lambda r: r["_key"])


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
                    max_rows: int = 2500, max_chars: int = 10_000, held_out_of: int = 5) -> tuple[list[str], np.ndarray]:
    """At most ``max_rows`` labelled texts, by a hash of the key, of ``max_rows * max_chars`` code points together.

    A longer text than ``max_chars`` that is not toxic is represented by ``PIECES`` passages spread over it, for which the
    label holds as well; a toxic one is taken whole, unless the total is used up. Rows whose crc32(key as text) modulo
    ``held_out_of`` is 0 are never used. Of rows that share a key, one label (the larger) and one text (the smallest)
    count; null keys, labels and texts are not used."""
    rows = _sample(docs, labels, key, text, label, max_rows, max_chars, held_out_of)
    return [r["_text"] for r in rows], np.array([r["_label"] for r in rows], np.float32)


def _bit(key: str) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(KEY_BITS))


def known_bits(known: DataFrame) -> np.ndarray:
    """A bit per hash of a key in ``known`` (_key): at most ``KEY_BITS / 32768`` bitmaps of 4 KB come to the driver, whatever the number of keys."""
    marked = known.select((_bit("_key") + 1).alias("b")).groupBy(F.bitmap_bucket_number("b").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("bits")).collect()
    bits = np.zeros(KEY_BITS // 8, np.uint8)
    for r in marked:
        bits[(r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    return bits


def score_likely(rows: DataFrame, known: DataFrame, model: ToxicModel) -> DataFrame:
    """(_of, _score) of the rows (_of, _text) whose key may be in ``known``: no known key is lost, and few others stay while
    keys are fewer than bits. Texts without a label are passed over before they are scored, and no text is shuffled."""
    context = rows.sparkSession.sparkContext
    bits, shared = context.broadcast(known_bits(known)), context.broadcast(model)

    def score(batches):
        for batch in batches:
            at = batch.column("_bit").to_numpy()
            own = batch.filter(pa.array(((bits.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)))
            yield pa.RecordBatch.from_arrays([own.column("_of"), pa.array(shared.value.score(own.column("_text")))], names=["_of", "_score"])

    return rows.withColumn("_bit", _bit("_of")).mapInArrow(score, f"_of {rows.schema['_of'].dataType.simpleString()}, _score double")


def score_bins(docs: DataFrame, labels: DataFrame, model: ToxicModel, trained: list, key: str = "doc_id", text: str = "text",
               label: str = "toxic", held_out_of: int = 5) -> dict[tuple[int, int], int]:
    """{(bin of the logit above the model's threshold, label 0/1): rows} of all labelled rows with words, whole, without the
    held-out fold and the keys in ``trained``. Only scores are shuffled; one count per bin and label comes to the driver."""
    rows = docs.select(F.col(key).alias("_of"), F.col(text).alias("_text"))
    known = _known_labels(labels, key, label, held_out_of)
    if trained:
        known = known.join(F.broadcast(docs.sparkSession.createDataFrame([(k,) for k in trained], known.select("_key").schema)), "_key", "left_anti")
    score = F.col("_score")
    logit = F.when(score >= 1, F.lit(float(BIN_SPAN))).otherwise(F.ln(score) - F.ln(1 - score))
    bin_ = F.least(F.greatest(F.floor(logit * BINS), F.lit(-BIN_SPAN * BINS)), F.lit(BIN_SPAN * BINS - 1)).cast("int")
    found = score_likely(rows.filter(F.col("_of").isNotNull()), known, model).filter(score > 0).join(known, F.col("_of") == F.col("_key")) \
        .groupBy(bin_.alias("bin"), (F.col("_label") > 0).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()
    return {(r["bin"], r["toxic"]): r["n"] for r in found}


def _best_bin(counts: dict[tuple[int, int], int]) -> float:
    """Threshold of the best F1 over binned logits, in the middle of the empty bins below it."""
    at = np.array(sorted({b for b, _ in counts}, reverse=True))
    right, wrong = (np.cumsum([counts.get((int(b), y), 0) for b in at]) for y in (1, 0))
    best = int(np.argmax(2 * right / (right + wrong + right[-1])))
    below = at[best + 1] + 1 if best + 1 < len(at) else at[best]
    return float(at[best] + below) / 2 / BINS


def fit_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
                 max_rows: int = 2500, max_chars: int = 10_000, held_out_of: int = 5) -> ToxicModel:
    """Network from ``labelled_sample``, threshold from all labelled rows outside the held-out fold.

    Rows that trained as a whole count with the score they had as unseen documents, all others with the model's own."""
    sample = _sample(docs, labels, key, text, label, max_rows, max_chars, held_out_of)
    toxic = np.array([r["_label"] for r in sample], np.float32)
    keys, whole, texts = [r["_key"] for r in sample], [r["_whole"] for r in sample], [r["_text"] for r in sample]
    del sample
    model, decided, present = _train(texts, toxic)
    if not len(decided):
        return model
    counts = score_bins(docs, labels, model, [k for k, w in zip(keys, whole) if w], key, text, label, held_out_of)
    if counts:
        above = np.clip(np.floor((decided - model.network.shift) * BINS), -BIN_SPAN * BINS, BIN_SPAN * BINS - 1).astype(int)
        for b, i in zip(above.tolist(), present.tolist()):
            if whole[i]:
                pair = (b, int(toxic[i] > 0))
                counts[pair] = counts.get(pair, 0) + 1
        if any(y for _, y in counts):
            model.network.shift += _best_bin(counts)
    return model


def _scorer(shared, text, carry, clean_only):
    def score(batches):
        model = shared.value
        for batch in batches:
            scores = model.score(batch.column(text))
            out = pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), pa.array(scores)], names=[*carry, "_score"])
            yield out.filter(pa.array(scores < 0.5)) if clean_only else out

    return score


def score_toxicity(docs: DataFrame, model: ToxicModel, text: str = "text", keep: list[str] | None = None,
                   clean_only: bool = False) -> DataFrame:
    """``keep`` columns (all by default) and ``_score`` (0..1, toxic from 0.5); ``clean_only`` drops toxic rows.

    * null and empty texts and texts without words score 0
    * long texts are read whole, window by window; repeated rows score alike; null keys are kept
    * an empty table gives no rows; a model from no labels, or labels of one kind, scores everything 0
    * a column of ``docs`` called ``_score`` is replaced; only the text is an input
    """
    docs = docs.drop("_score")
    carry = keep if keep is not None else docs.columns
    found = docs.select(*dict.fromkeys([*carry, text]))
    schema = "".join(f"`{c}` {found.schema[c].dataType.simpleString()}, " for c in carry) + "_score double"
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return found.mapInArrow(_scorer(shared, text, carry, clean_only), schema)
