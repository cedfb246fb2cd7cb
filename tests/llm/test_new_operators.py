"""op11 to op13 against plain versions, on the small table and on odd rows."""

import base64
import collections
import hashlib
import json
import re
import string
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from spendlens.llm import order_minhash, token_alignment, trie_frontier
from spendlens.llm.catalog import QUERIES, load
from tests.llm import fixtures as fx

load()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# ---- op11

JOIN = re.escape(" \t\n\x0b\f\r" + string.punctuation)
KMER = re.compile(rf"(?s)(?=(.{{1,{order_minhash.K}}}))(?:[0-9A-Za-zª-ʯͰ-῿]{{1,24}}[{JOIN}]*|.)")


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def hash_of(*parts):
    seed = 42
    for p in parts:
        data = p.encode() if isinstance(p, str) else p.to_bytes(4 if isinstance(p, np.int32) else 8, "little", signed=True)
        seed = xxhash.xxh64_intdigest(data, seed)
    return seed


def plain_signature(text):
    """Occurrence-numbered k-mers, the least of each half bin, tuples in text order."""
    seen, halves = collections.Counter(), {}
    for place, m in enumerate(KMER.finditer(text)):
        kmer = signed(hash_of(m.group(1))) >> 28
        seen[kmer] += 1
        number = hash_of(kmer, int.__new__(Int32, seen[kmer]))
        half = signed(number) >> 57
        if half not in halves or ((signed(number) >> 28), place) < halves[half]:
            halves[half] = (signed(number) >> 28, place)
    bins = collections.defaultdict(list)
    for half, (number, place) in halves.items():
        bins[half >> 1].append((place, number))
    out = {}
    for b, pairs in bins.items():
        out[b & 63] = hash_of(*(n for _, n in sorted(pairs))) & ((1 << 26) - 1)
    return out


class Int32(int):
    def to_bytes(self, length=4, byteorder="little", *, signed=False):
        return int(self).to_bytes(4, byteorder, signed=signed)


def as_bins(values):
    return {(v & 0xFFFFFFFF) >> 26: v & ((1 << 26) - 1) for v in values}


def plain_likeness(a, b):
    either = a.keys() | b.keys()
    return sum(k in a and k in b and a[k] == b[k] for k in either) / len(either) if either else 1.0


def test_fingerprints_follow_the_plain_version(spark):
    texts = [(i, t) for i, (_, t, *_) in enumerate(fx.odd_documents())] + [(100, "漢字かな交じり文" * 5), (101, "a" * 5000), (102, "😀 x😀y " * 9)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r["doc_id"]: as_bins(r["signature"]) for r in order_minhash.fingerprints(fx.with_clashes(df)).collect()}
    assert got == {i: plain_signature(t or "") for i, t in texts}


def test_fingerprint_query(spark, docs):
    got = {r["doc_id"]: r for r in QUERIES["op11_fingerprints"](spark, SF).collect()}
    order = sorted(docs)
    assert len(got) == len(order)
    for n, (i, text) in enumerate(order):
        after = order[(n + 1) % len(order)][1]
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + after[:quarter]
        own, changed, following = map(plain_signature, (text, edited, after))
        r = got[i]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        parts = [int(r["fingerprint"][k : k + 8], 16) for k in range(0, len(r["fingerprint"]), 8)]
        assert as_bins(parts) == own
        assert r["near_edited"] == pytest.approx(plain_likeness(own, changed)) and r["near_next"] == pytest.approx(plain_likeness(own, following))
    assert np.mean([r["near_edited"] for r in got.values()]) > 0.3 > 0.05 > np.mean([r["near_next"] for r in got.values()])


def test_fingerprints_feel_order(spark):
    words = fx.prose(__import__("random").Random(3), 400, vocab=5000).split()
    text, moved, fewer = " ".join(words), " ".join(words[200:] + words[:200]), " ".join(words[:-40])
    rows = spark.createDataFrame([(1, text), (2, moved), (3, fewer), (4, text)], "doc_id long, text string")
    got = {r["doc_id"]: as_bins(r["signature"]) for r in order_minhash.fingerprints(rows).collect()}
    assert got[1] == got[4] and plain_likeness(got[1], got[2]) < 0.75 < plain_likeness(got[1], got[3])


def test_edited_fingerprints_of_odd_rows(spark):
    rows = fx.odd_documents()
    got = order_minhash.edited_fingerprints(fx.with_clashes(fx.documents(spark))).collect()
    assert len(got) == len(rows)
    distinct = sorted({(r[0], r[1] or "") for r in rows if r[0] is not None})
    after = {a[0]: b for a, b in zip(distinct, distinct[1:])}
    for r in got:
        if r["doc_id"] in after:
            text = dict(distinct)[r["doc_id"]]
            q = len(text) // 4
            assert r["edited"] == text[: len(text) - q] + after[r["doc_id"]][1][:q] and r["next_key"] == after[r["doc_id"]][0]
    assert order_minhash.edited_fingerprints(fx.documents(spark, [])).count() == 0
    one = order_minhash.edited_fingerprints(fx.documents(spark, [(5, "a b c d e f", None, None, None)])).collect()
    assert [r["next_key"] for r in one] == [5]


# ---- op12


def plain_groups(texts):
    """{row: (a ids, b ids, groups)} with the tokenizers' own encoders and sets of ends."""
    import sentencepiece
    import tokenizers

    a_file, b_file = f"{token_alignment.TOKENIZERS}/byte_bpe_50k.json", f"{token_alignment.TOKENIZERS}/piece_bpe_32k.model"
    a, b = tokenizers.Tokenizer.from_file(a_file), sentencepiece.SentencePieceProcessor(model_file=b_file)
    a.encode_special_tokens = True
    with open(a_file, encoding="utf-8") as f:
        entries = {i: t for t, i in json.load(f)["model"]["vocab"].items()}
    printable = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or c >= 174]
    letter = {chr(c): c for c in printable} | {chr(256 + n): c for n, c in enumerate(c for c in range(256) if c not in printable)}
    out = []
    for text in texts:
        raw = b" " + (text or "").encode()
        ids_a, ids_b = a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or "")
        bytes_a = [bytes(letter[c] for c in entries[i]) for i in ids_a]
        pieces = [b.id_to_piece(i) for i in ids_b]
        bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
        if not text or b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            out.append(None)
            continue
        ends_a, ends_b = np.cumsum(list(map(len, bytes_a))).tolist(), np.cumsum(list(map(len, bytes_b))).tolist()
        common = sorted(set(ends_a) & set(ends_b))
        groups, i, j = [], 0, 0
        for end in common:
            k, m = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
            groups.append((ids_a[i:k], ids_b[j:m]))
            i, j = k, m
        out.append((ids_a, ids_b, groups))
    return out


def plain_alignment(rows):
    aligned = plain_groups([t for _, t in rows])
    links = [collections.Counter((x, y) for g in (d[2] if d else ()) for x in g[0] for y in g[1]) for d in aligned]
    held = collections.Counter(pair for d in links for pair in d)
    most = collections.Counter()
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    out = []
    for (i, _), d, own in zip(rows, aligned, links):
        if d is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in d[2])
        out.append((i, len(d[0]), len(d[1]), len(d[2]), sum(own.values()), sum(n for (x, y), n in own.items() if held[x, y] == most[x]),
                    sum(n * held[p] for p, n in own.items()), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


ALIGNED = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment_query(spark, docs):
    assert rows_of(QUERIES["op12_token_alignment"](spark, SF), *ALIGNED) == plain_alignment(docs)


ODD_TEXTS = ["<|endoftext|> and <s> </s>", "a▁b", "漢字 and кириллица ẞ ﬁ", "x" * 3000, " " * 2500 + "end", "  　 wide\u0085", "😀👩‍👩‍👧 é",
             "tab\tnew\n\n\nline\r\n", "\x00\x01", "don't we'll I'm", "١٢٣ ⅷ ½", "﻿bom", "abc" * 2000 + " d"]


@pytest.mark.parametrize("block_pairs", [token_alignment.BLOCK_PAIRS, 700])
def test_alignment_of_odd_rows(spark, block_pairs):
    rows = [(r[0], r[1]) for r in fx.odd_documents()] + [(200 + i, t) for i, t in enumerate(ODD_TEXTS)]
    df = fx.with_clashes(spark.createDataFrame(rows, "doc_id long, text string")).repartition(3)
    assert rows_of(token_alignment.aligned_counts(df, block_pairs=block_pairs), *ALIGNED) == plain_alignment(rows)
    assert token_alignment.aligned_counts(fx.documents(spark, [])).count() == 0


def test_common_ends_of_random_arrays():
    rng = np.random.default_rng(4)
    for n in (1, 2, 63, 64, 65, 700):
        for share in (0.0, 0.3, 0.95, 1.0):
            both = np.sort(rng.choice(5 * n, n, replace=False))
            a, b = (np.unique(np.append(rng.choice(5 * n, n // 2), [*both[rng.random(n) < share], 5 * n])) for _ in "ab")
            i, j = token_alignment.common_ends(a, b)
            assert a[i].tolist() == b[j].tolist() == sorted(set(a.tolist()) & set(b.tolist()))


def test_wide_groups_are_paired_by_distinct_tokens(monkeypatch):
    with open(f"{token_alignment.TOKENIZERS}/byte_bpe_50k.json", "rb") as a, open(f"{token_alignment.TOKENIZERS}/piece_bpe_32k.model", "rb") as b:
        coder = token_alignment.codec((a.read(), b.read()))
    aligned = token_alignment.Aligned(coder, [fx.prose(__import__("random").Random(1), 300), "xyzzyé" * 200])
    usual = aligned.links()
    monkeypatch.setattr(token_alignment, "WIDE", 1)
    assert all(np.array_equal(x, y) for x, y in zip(usual, aligned.links()))


def test_both_encoders_agree_on_every_letter():
    """The fast encoder stands in for the tokenizer file: same ids on every assigned code point, in and between words."""
    with open(f"{token_alignment.TOKENIZERS}/byte_bpe_50k.json", "rb") as a, open(f"{token_alignment.TOKENIZERS}/piece_bpe_32k.model", "rb") as b:
        coder = token_alignment.codec((a.read(), b.read()))
    points = [c for c in range(1, 0x20000) if not 0xD800 <= c < 0xE000]
    for lo in range(0, len(points), 500):
        text = "".join(f" a{chr(c)}1{chr(c)} {chr(c)}." for c in points[lo : lo + 500])
        want = coder.exact.encode(" " + text, add_special_tokens=False).ids
        assert coder.fast.encode_ordinary(" " + text) == want, hex(points[lo])


# ---- op13


def plain_groups_of_words(words):
    n = {w: k for w, k in collections.Counter(w for w in words if w).items() if len(w) >= 5 and k >= 3}
    shapes = collections.defaultdict(set)
    for w in n:
        for p in range(len(w)):
            shapes[w[:p] + "\0" + w[p + 1 :]].add(w)
    near = collections.defaultdict(set)
    for same in shapes.values():
        for w in same:
            near[w] |= same - {w}
    for w in n:
        for p in range(len(w)):
            if (x := w[:p] + w[p + 1 :]) in n:
                near[w].add(x)
                near[x].add(w)
    form = {}
    for w in n:
        if near[w]:
            best = min(near[w], key=lambda x: (-n[x], x))
            if n[best] >= 2 * n[w]:
                form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out, key=repr)


SPELLED = ["word", "form", "root", "n", "n_near", "form_n"]


def test_spelling_query(spark, docs):
    words = []
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(fx.LOWER)
            h = zlib.crc32(f"{i}:{run}".encode())
            words.append(run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :])
    assert rows_of(QUERIES["op13_spelling_variants"](spark, SF), *SPELLED) == plain_groups_of_words(words)


def test_spelling_of_odd_words(spark):
    import random

    rng = random.Random(8)
    words = [None, "", "abcd", "a" * 4000, "a" * 3999] * 4 + ["aaaaa" + "a" * k for k in range(30) for _ in range(3 + k)]
    base = ["".join(rng.choice("abcé") for _ in range(rng.randrange(4, 9))) for _ in range(400)]
    for w in base:
        words += [w] * rng.randrange(1, 12)
    df = fx.with_clashes(spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, n int"))
    assert rows_of(trie_frontier.spelling_groups(df), *SPELLED) == plain_groups_of_words(words)
    assert trie_frontier.spelling_groups(df.filter("false")).count() == 0


def test_short_words_reach_their_start(spark):
    words = [w for w in ("a", "b", "ab", "abc", "xbc", "bc", "ba") for _ in range(3)]
    df = spark.createDataFrame([(w,) for w in dict.fromkeys(words)], "word string")
    got = {(r["word"], r["near"]) for r in trie_frontier.near_words(df).collect()}
    want = set()
    for a in dict.fromkeys(words):
        for b in dict.fromkeys(words):
            sub = len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1
            cut = abs(len(a) - len(b)) == 1 and any(max(a, b, key=len)[:p] + max(a, b, key=len)[p + 1 :] == min(a, b, key=len) for p in range(max(len(a), len(b))))
            if sub or cut:
                want.add((a, b))
    assert got == want


def test_levels_do_not_grow_with_word_length(spark):
    long = spark.createDataFrame([("q" * 5_000 + c,) for c in "abc"], "word string")
    assert trie_frontier.near_words(long).count() == 6
    assert trie_frontier.trie_edges(trie_frontier.trie_paths(long)).filter(F.char_length("label") > 1000).count() > 0


def test_json_and_ranks_hold_the_same_vocabulary():
    with open(f"{token_alignment.TOKENIZERS}/byte_bpe_50k.json", "rb") as a, open(f"{token_alignment.TOKENIZERS}/piece_bpe_32k.model", "rb") as b:
        coder = token_alignment.codec((a.read(), b.read()))
    with open(f"{token_alignment.TOKENIZERS}/byte_bpe_50k.tiktoken", "rb") as f:
        ranks = {base64.b64decode(x): int(n) for x, n in map(bytes.split, f)}
    assert {coder.fast.decode_single_token_bytes(i): i for i in ranks.values()} == ranks
