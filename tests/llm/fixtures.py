"""Small tables with nulls, empty and long texts, ties, repeated rows, and extra columns with clashing names."""

import collections
import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def norm_words(text):
    return ALNUM.findall((text or "").translate(LOWER))


def prose(rng, n, vocab=400):
    return " ".join(f"w{rng.randrange(vocab)}é" if rng.random() < 0.1 else f"w{rng.randrange(vocab)}" for _ in range(n))


def odd_documents():
    rng = random.Random(5)
    base = prose(rng, 120)
    near = base.split()
    near[60] = "changed"
    line = "this line is long enough to count and stands in many documents"
    texts = [None, "", " \n\t ", "one", "two words", base, base, " ".join(near), base.upper() + "!", prose(rng, 30_000),
             "\n".join([line, "  " + line.upper() + "\t", "own " + prose(rng, 9)]), "!!! ###", "a b c a b c a b c\nx\nx\n\nx", "Ünï cödé ß"]
    texts += [line + "\n" + prose(rng, 20 + i) for i in range(6)]
    rows = [(i, t, "en", None if i % 5 == 0 else f"src{i % 3}", None) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, "no id " + base, "en", "src1", 1), (None, line, None, None, None)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: columns whose names the operators use for themselves
CLASH = ["size", "score", "_score", "shard", "slot", "h", "docs", "holder", "_copies", "_key", "class", "node", "bands", "_items", "n_words", "codes"]


def documents(spark, rows=None):
    return spark.createDataFrame(odd_documents() if rows is None else rows, SCHEMA)


def with_clashes(df):
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(7) for c in CLASH})


def multiset(text, k=5):
    words = norm_words(text)
    if not words:
        return collections.Counter()
    if len(words) < k:
        return collections.Counter([tuple(words)])
    return collections.Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def jaccard(a, b):
    union = sum((a | b).values())
    return sum((a & b).values()) / union if union else 0.0


def brute_classes(rows):
    """{doc_id: class} by comparing all pairs."""
    docs = {i: multiset(t) for i, t in rows if i is not None}
    up = {i: i for i in docs}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(docs)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if docs[a] and docs[b] and jaccard(docs[a], docs[b]) >= 0.8:
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: root(i) for i in ids}
