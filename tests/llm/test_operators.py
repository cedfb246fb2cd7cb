"""Operators against brute force, on odd rows and on the small tables."""

import collections
from fractions import Fraction
import hashlib
import pathlib
import random
import re
import textwrap
import zlib

import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from spendlens.llm import bag_minhash, chat_parts, feistel_shards, license_digests, line_runs, link_trust, mix_fill, ngram_leaks
from spendlens.llm import quality_forest, toxic_gru
from tests.llm import fixtures as fx

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark):
    return fx.with_clashes(fx.documents(spark)).cache()


@pytest.fixture(scope="module")
def texts(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def empty(spark):
    return fx.documents(spark, [])


# --- op1


def brute_statistics(text):
    text = text or ""
    words = fx.WORD.findall(text)
    lines = [x for x in text.split("\n") if fx.WORD.search(x)]
    times = collections.Counter(zip(words, words[1:], words[2:]))
    hit = set()
    for i, w in enumerate(zip(words, words[1:], words[2:])):
        if times[w] > 1:
            hit |= {i, i + 1, i + 2}
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit))


def test_statistics(spark, odd, texts):
    got = quality_forest.rule_statistics(odd).collect()
    want = [(r[0], *brute_statistics(r[1])) for r in fx.odd_documents()]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    whole = quality_forest.rule_statistics(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    assert {r[0]: tuple(r[1:]) for r in whole} == {i: brute_statistics(t) for i, t in texts}


def test_forest_isolates_and_calibrates(spark):
    rng = np.random.default_rng(1)
    rows = np.column_stack((rng.normal(5, 0.2, 2000), np.zeros(2000), np.zeros(2000), np.zeros(2000)))
    rows[:40, 1] = rng.uniform(1, 3, 40)
    forest = quality_forest.IsolationForest(rows)
    scores = forest.score(rows)
    assert scores[:40].min() > np.quantile(scores[40:], 0.95)
    got = entry.queries()["op1_quality_rules"](spark, "/root/testdata/sf0.01").toPandas().set_index("doc_id")
    quality = pd.read_parquet("/root/testdata/sf0.01/labels.parquet").set_index("doc_id")["quality"]
    open_ = got[~got.base_failed].join(quality, how="inner")
    assert open_[open_.quality == 1].kept.mean() > 0.98
    assert open_[open_.quality == 0].kept.mean() < 0.1
    assert (got.base_failed == ((got.n_words < 50) | (100 * got.n_repeat_words > 50 * got.n_words))).all()
    assert not got[got.base_failed].kept.any()


def test_forest_verdicts_on_odd_rows(spark, odd):
    labels = spark.createDataFrame([(5, 1, 0), (None, 0, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    got = quality_forest.forest_verdicts(odd, labels)
    assert got.count() == odd.count() and got.filter("kept is null").count() == 0
    assert quality_forest.forest_verdicts(empty(spark), labels).count() == 0


# --- op2


def brute_lines(rows, least=40, docs=5):
    held = collections.defaultdict(set)
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(fx.LOWER)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least:
                held[key(line)].add(i)
    order = lambda i: float("-inf") if i is None else i
    last = {k: max(v, key=order) for k, v in held.items() if len(v) >= docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if key(x) not in last or last[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out


@pytest.mark.parametrize("batches", [1, 3, 6])
def test_lines(odd, batches):
    got = line_runs.drop_shared_lines(odd, batches=batches).collect()
    want = brute_lines([r[:2] for r in fx.odd_documents()])
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert sum(x[2] for x in want) > 5


def test_runs_are_compacted(spark):
    runs = line_runs.LevelledRuns(fan_in=2)
    for last in (40, 30, 20, 10, 5):
        runs.add(spark.createDataFrame([("a", 1, last), (f"own{last}", 2, last)], "h string, docs long, last long"))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    assert {tuple(r) for r in runs.compact().collect()} == {("a", 5, 40), *((f"own{x}", 2, x) for x in (40, 30, 20, 10, 5))}


def test_lines_of_no_documents(spark):
    assert line_runs.drop_shared_lines(empty(spark)).count() == 0


# --- op3


@pytest.mark.parametrize("n", [1, 2, 7, 64, 1000, 4097])
def test_permutation(n):
    image = feistel_shards.permute(np.arange(n), n, seed=3)
    assert sorted(image) == list(range(n))
    assert (feistel_shards.unpermute(image, n, seed=3) == np.arange(n)).all()
    if n >= 1000:
        assert abs(np.corrcoef(np.arange(n), image)[0, 1]) < 0.1
        assert (image != feistel_shards.permute(np.arange(n), n, seed=4)).any()


def test_shards(spark, odd, texts):
    for docs, rows in ((odd, [r[:2] for r in fx.odd_documents()]), (spark.read.parquet(f"{SF}/documents.parquet"), texts)):
        got = feistel_shards.shard_documents(docs).toPandas()
        want = sorted(str((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))) for i, t in rows)
        ids = [None if pd.isna(i) else int(i) for i in got.doc_id]
        assert sorted(str(x) for x in zip(ids, got["size"].tolist(), got.text_crc32.tolist())) == want
        counts = got.groupby("shard").size()
        assert counts.max() - counts.min() <= 1
        assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
        again = feistel_shards.shard_documents(docs.repartition(5)).toPandas()
        key = ["doc_id", "text_crc32", "shard", "slot"]
        assert sorted(map(str, got[key].values.tolist())) == sorted(map(str, again[key].values.tolist()))
    assert feistel_shards.shard_documents(empty(spark)).count() == 0


def test_places_can_be_computed(spark):
    rows = spark.range(100).selectExpr("id as doc_id", "'x' as text")
    numbered, n = feistel_shards.row_numbers(rows, ["doc_id"])
    numbers = {r["doc_id"]: r["row_number"] for r in numbered.collect()}
    placed = {r["doc_id"]: (r["shard"], r["slot"]) for r in feistel_shards.shuffle_into_shards(rows, ["doc_id"]).collect()}
    for i, (shard, slot) in placed.items():
        assert feistel_shards.unpermute(np.array([slot * 8 + shard]), n)[0] == numbers[i]


# --- op4


def brute_trust(pages, links, steps=200, damping=0.85):
    """pages: host -> (pages, allowed, blocked); links: (src, dst) -> w."""
    hosts = sorted({*pages, *(h for e in links for h in e)})
    at = {h: i for i, h in enumerate(hosts)}
    w = np.zeros((len(hosts), len(hosts)))
    for (a, b), n in links.items():
        w[at[a], at[b]] = n
    n, good, bad = (np.array([pages.get(h, (0, 0, 0))[k] for h in hosts], float) for k in range(3))

    def rank(seed, w):
        total = max(seed.sum(), 1)
        s, r = seed / total, seed / total
        share = np.divide(w, w.sum(1, keepdims=True), out=np.zeros_like(w), where=w.sum(1, keepdims=True) > 0)
        for _ in range(steps):
            part = r @ share
            r = damping * part + (1 - damping * part.sum()) * s
        return r * total / np.maximum(n, 1)

    return {h: (t, d) for h, t, d in zip(hosts, rank(good, w), rank(bad, w.T))}


def test_urls(spark):
    link = lambda *hosts: " ".join(f'<p><a class="x" href="http://{h}/en/">y</a>' for h in hosts)
    long = "x" * 200_000
    rows = [
        (1, "http://a.com/", link("b.org", "b.org", "c.org"), 0), (2, "HTTP://B.ORG/x?y://z", link("c.org") + long, 0),
        (3, "https://c.org?q=/en/", None, 0), (4, "https://www.example.com/en/1#f", "", 0), (5, "https://m.example.com/en/1", link("a.com"), 0),
        (6, "https://d.net/es/1", link("d.net"), 0), (7, "https://d.net/fr/", '<a href="/local">', 0), (8, "https://e.org/", link("d.net"), 0),
        (9, "no url", link("d.net"), 0), (10, None, None, 0), (11, "", "", 0), (12, "https://e.org/two", '<a href=//D.net/es>', 0),
        (13, "ftp://xcom/", "", 0), (13, "ftp://xcom/", "", 0), (None, "https://f.org#://a.com/", link("e.org"), 0), (14, "https://net/es/", "", 0),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host int")
    got = [r.asDict() for r in link_trust.judge_urls(pages.withColumnRenamed("host", "verdict")).collect()]
    by = {r["page_id"]: r for r in got}
    assert len(got) == len(rows)
    assert [(by[i]["host"], by[i]["path"], by[i]["rule"]) for i in (1, 2, 3, 4, 5, 6, 7, 9, 10, 13, 14)] == [
        ("a.com", "/", "com/"), ("b.org", "/x", None), ("c.org", "", None), ("www.example.com", "/en/1", "www.example.com/en/"),
        ("m.example.com", "/en/1", "example.com/en/"), ("d.net", "/es/1", "net/es/"), ("d.net", "/fr/", "net/fr/"), ("", "", None),
        ("", "", None), ("xcom", "/", None), ("net", "/es/", "net/es/")]
    counts = {"a.com": (1, 1, 0), "b.org": (1, 0, 0), "c.org": (1, 0, 0), "www.example.com": (1, 1, 0), "m.example.com": (1, 0, 1),
              "d.net": (2, 0, 2), "e.org": (2, 0, 0), "": (3, 0, 0), "xcom": (2, 0, 0), "f.org": (1, 0, 0), "net": (1, 0, 1)}
    links = {("a.com", "b.org"): 1, ("a.com", "c.org"): 1, ("b.org", "c.org"): 1, ("m.example.com", "a.com"): 1, ("e.org", "d.net"): 2, ("f.org", "e.org"): 1}
    want = brute_trust(counts, links)
    for r in got:
        assert (r["host_trust"], r["host_distrust"]) == pytest.approx(want[r["host"]], abs=1e-9)
    assert by[8]["verdict"] == "block" and by[12]["verdict"] == "block"  # they link to a blocked host
    assert by[2]["verdict"] == "allow" and by[9]["verdict"] == "allow" and by[4]["verdict"] == "allow"
    assert link_trust.judge_urls(pages.limit(0)).count() == 0


# --- op5


def brute_leaks(rows, items, n=10):
    grams = collections.defaultdict(set)
    for i, t in items:
        w = fx.norm_words(t)
        k = min(n, len(w))
        for p in range(len(w) - k + 1 if w else 0):
            grams[tuple(w[p : p + k])].add("" if i is None else str(i))
    out = []
    for i, t in rows:
        w, hit, found = fx.norm_words(t), set(), set()
        for k in {len(g) for g in grams}:
            for p in range(len(w) - k + 1):
                if own := grams.get(tuple(w[p : p + k])):
                    hit |= set(range(p, p + k))
                    found |= own
        out.append((i, len(w), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize("block_bytes", [32 << 20, 300])
def test_leaks(spark, odd, block_bytes):
    base = fx.norm_words(fx.odd_documents()[5][1])
    items = [(1, " ".join(base[3:20])), (2, " ".join(base[15:40]).upper()), (3, "two; WORDS"), (4, None), (5, ""), (None, " ".join(base[90:101])),
             (6, "this line is long enough to count and stands in many"), (6, "one"), (7, "this line is long enough to count and stands in many")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = ngram_leaks.find_leaks(odd, bench, keep=["doc_id"], block_bytes=block_bytes).collect()
    want = brute_leaks([r[:2] for r in fx.odd_documents()], items)
    assert sorted(str((r[0], r[1], r[2], r[4])) for r in got) == sorted(map(str, want))
    clean = ngram_leaks.find_leaks(odd, bench, clean_only=True, block_bytes=block_bytes)
    assert clean.count() == sum(not w[2] for w in want) and set(odd.columns) - {"_items"} < set(clean.columns)
    assert ngram_leaks.find_leaks(empty(spark), bench).count() == 0
    assert ngram_leaks.find_leaks(odd, bench.limit(0)).filter("_n_hit > 0").count() == 0


def test_redact():
    assert ngram_leaks.redact("Ünï. A b, c!d e", [1, 3]) == "Ünï. , c!d e"[:5] + ", c!d e"


# --- op6


def test_licenses(spark):
    mit = license_digests.KNOWN["MIT"]
    spelled = "Copyright (c) 2020 Some One\n" + mit.upper().replace("LICENSE", "licence").replace(",", " ;")
    rows = [(1, mit), (2, spelled), (3, mit + " more"), (4, None), (5, ""), (6, "text\n  released under the MIT licence\nCopyright me"),
            (7, license_digests.KNOWN["ISC"]), (7, license_digests.KNOWN["ISC"]), (None, "licence licence licence"), (8, "x " * 100_000)]
    docs = fx.with_clashes(spark.createDataFrame(rows, "doc_id long, text string"))
    got = license_digests.scan_licenses(docs).collect()
    want = [(i, hashlib.sha256(license_digests.canonical_text(t).encode()).hexdigest()) for i, t in rows]
    assert sorted(map(str, want)) == sorted(str((r[0], r[1])) for r in got)
    found = {r["doc_id"]: (r["license"], r["n_notice_lines"]) for r in got}
    assert {i: found[i][0] for i in (1, 2, 3, 4, 5, 7)} == {1: "MIT", 2: "MIT", 3: None, 4: None, 5: None, 7: "ISC"}
    assert found[6] == (None, 1)
    assert license_digests.scan_licenses(docs.limit(0)).count() == 0


def test_wrapped_licenses_keep_their_lines(spark):
    """Wherever a wrap puts 'copyright' first on a line, the line stays; notices go."""
    head = "Copyright (c) 2020, Some One\nCopyright Joyent, Inc. and others\n(c) 2021 Other\n© Third\nCopr. 1999 Fourth\nAll rights reserved.\n\n"
    rows, want = [], []
    for name in ("BSD-2-Clause", "BSD-3-Clause", "MIT", "ISC"):
        words = license_digests.KNOWN[name].split()
        wraps = [textwrap.fill(" ".join(words), w) for w in range(40, 90)]
        # every 'copyright' first on a line of its own
        wraps.append(re.sub(r"(?i) (?=copyright)", "\n", " ".join(words)))
        for text in wraps:
            rows.append((len(rows), head + text))
            want.append(name)
    assert sum(bool(re.search("(?mi)^copyright (notice|holders)", t)) for _, t in rows) > 20
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in license_digests.scan_licenses(docs).collect()}
    assert [got[i]["license"] for i, _ in rows] == want
    import duckdb

    documents = pd.DataFrame(rows, columns=["doc_id", "text"])  # noqa: F841
    sql = duckdb.sql(entry.oracle_sql()["op6_license_scans"]).fetchall()
    assert sorted(sql) == sorted(tuple(got[i]) for i, _ in rows)


def test_full_licenses_and_their_variants(spark):
    bsd, mit, isc = (license_digests.KNOWN[k] for k in ("BSD-3-Clause", "MIT", "ISC"))
    starred = re.sub(r"\b[123]\. ", "* ", bsd)
    folder = pathlib.Path(license_digests.__file__).parent / "licenses"
    long = {p.stem: p.read_text() for p in sorted(folder.glob("*.txt")) if not p.stem.endswith(".b")}
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "CC-BY-SA-4.0"} <= set(long)
    cases = [("MIT", mit.split("\n\n", 1)[1]), ("MIT", mit.replace("MIT License", "The MIT License (MIT)\n\nCopyright (c) 2020 A")),
             ("ISC", isc.split("\n\n", 1)[1]), ("BSD-3-Clause", "BSD 3-Clause License\n\nCopyright (c) 2020, A\n\n" + bsd),
             ("BSD-3-Clause", "BSD 3-Clause License\n\n" + starred), ("BSD-3-Clause", starred.replace("COPYRIGHT HOLDER OR", "COPYRIGHT OWNER OR")),
             ("GPL-2.0", long["GPL-2.0"].replace("51 Franklin Street, Fifth Floor, Boston, MA 02110-1301", "59 Temple Place, Suite 330, Boston, MA 02111-1307")),
             ("GPL-3.0", long["GPL-3.0"].split("END OF TERMS")[0]), ("Apache-2.0", long["Apache-2.0"].split("APPENDIX:")[0]),
             *long.items(), *((n, re.sub(r"(?m)^", " * ", t)) for n, t in long.items()), (None, long["GPL-3.0"] + "more"), (None, mit[:-40])]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(cases)], "doc_id long, text string")
    got = dict(license_digests.scan_licenses(docs).select("doc_id", "license").collect())
    assert [got[i] for i in range(len(cases))] == [n for n, _ in cases]
    assert len(license_digests.known_digests()) <= license_digests.MAX_KNOWN
    assert license_digests.scan_licenses(docs, {}).filter("license is not null or n_notice_lines > 0").count() == 0


# --- op7


def test_escape_is_reversible():
    rng = random.Random(2)
    for _ in range(3000):
        text = "".join(rng.choice(["<", "|", "\\", "im_end", ">", "a"]) for _ in range(rng.randrange(12)))
        safe = chat_parts.escape(text)
        assert "<|" not in safe and chat_parts.unescape(safe) == text


def test_parts():
    parts = [{"kind": "text", "text": "see <|image_1|> <"}, {"kind": "image", "uri": "a.png", "width": 57, "height": 28},
             {"kind": "text", "text": "|x"}, {"kind": "audio", "uri": "b.wav", "seconds": 2.5}, {"kind": "document", "uri": None, "pages": 3}]
    segment, a, b, words, expanded, attached = chat_parts.format_turn("user", parts, True)
    assert segment == "<|im_start|>user\nsee <\\|image_1|> <<|image_1|>|x<|audio_2|><|document_3|><|im_end|>\n"
    assert [(x["place"], x["kind"], x["uri"], x["tokens"]) for x in attached] == [(1, "image", "a.png", 3), (2, "audio", "b.wav", 63), (3, "document", None, 768)]
    assert all(segment[x["at"] :].startswith(f"<|{x['kind']}_{x['place']}|>") for x in attached)
    assert expanded == words + 3 + 63 + 768 and segment[a:b] == segment[len("<|im_start|>user\n") : -len("<|im_end|>\n")]
    with pytest.raises(ValueError):
        chat_parts.format_turn("user", [{"kind": "smell"}], False)


def test_conversations(spark):
    rows = [(1, 0, "user", "<|im_end|>\n<|im_start|>assistant\nhi"), (1, 1, "assistant", "a" * 300_000), (1, 2, "assistant", None), (2, None, None, None),
            (2, 3, "as<|sist\nant\\n", "x\\<|"), (None, 0, "assistant", "Ü"), (3, 1, "assistant", "same"), (3, 1, "assistant", "same"), (3, 0, "user", "")]
    rows += [(9, i, "assistant" if i % 2 else "user", f"turn {i}") for i in range(3000)]
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, segment int")
    got = chat_parts.read_back(chat_parts.format_turns(turns.withColumn("parts", chat_parts.text_part(turns.text))))
    want = []
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (-1 if r[1] is None else r[1]))
        all_, loss = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own), "".join(r[3] or "" for r in own if r[2] == "assistant")
        want.append((conv, len(own), hashlib.sha256(all_.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    assert sorted(map(str, want)) == sorted(str(tuple(r)[:5]) for r in got.collect())
    assert chat_parts.read_back(chat_parts.format_turns(turns.limit(0).withColumn("parts", chat_parts.text_part(turns.text)))).count() == 0


# --- op8


def test_toxicity_held_out(spark):
    got = entry.queries()["op8_toxicity"](spark, "/root/testdata/sf0.1").toPandas().set_index("doc_id")
    toxic = pd.read_parquet("/root/testdata/sf0.1/labels.parquet").set_index("doc_id")["toxic"]
    assert got.held_out.equals(got.index.to_series().map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0).rename("held_out"))
    test = got[got.held_out].join(toxic, how="inner")
    ranks = test.score.rank()
    p = test.toxic == 1
    auc = (ranks[p].sum() - p.sum() * (p.sum() + 1) / 2) / (p.sum() * (~p).sum())
    assert auc > 0.93
    assert test[p].predicted.mean() > 0.8 and test[~p].predicted.mean() < 0.05
    assert got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = toxic_gru.Network(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = np.vstack((rng.normal(0, 1, (60, toxic_gru.WORD_DIM + toxic_gru.CHAR_DIM)), np.zeros((1, toxic_gru.WORD_DIM + toxic_gru.CHAR_DIM))))
    start, end, y = np.array([0, 24, 55]), np.array([32, 56, 60]), np.array([1.0, 0.0, 1.0])

    def loss(x):
        z = net.forward(x, start, end)
        return np.mean(np.log1p(np.exp(z)) - y * z)

    grads, dx, _ = net.gradients(x, start, end, y, np.ones(3))
    for name in ("Wf", "Ub", "cf", "a", "o", "q"):
        flat, at = net.p[name].reshape(-1), rng.integers(net.p[name].size)
        old = flat[at]
        flat[at] = old + 1e-3
        up = loss(x)
        flat[at] = old - 1e-3
        down = loss(x)
        flat[at] = old
        assert grads[name].reshape(-1)[at] == pytest.approx((up - down) / 2e-3, abs=2e-4)
    moved = x.copy()
    moved[30, 2] += 1e-3
    assert dx[30, 2] == pytest.approx((loss(moved) - loss(x)) / 1e-3, abs=2e-4)


def test_toxicity_on_odd_rows(spark, odd):
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(None, 1)], "doc_id long, toxic int")
    model = toxic_gru.fit_toxicity(odd, labels)
    got = toxic_gru.score_toxicity(odd, model)
    assert got.count() == odd.count()
    assert {r["_score"] for r in got.filter("text is null or text = ''").collect()} == {0.0}
    one = {r["_score"] for r in got.filter("doc_id = 5").collect()}
    assert len(one) == 1
    nothing = toxic_gru.fit_toxicity(odd, labels.limit(0))
    assert toxic_gru.score_toxicity(odd, nothing).filter("_score > 0.001").count() == 0
    assert toxic_gru.score_toxicity(empty(spark), model).count() == 0


def test_threshold_counts_all_labelled_rows(spark):
    """Long clean texts and rows beyond the training sample count for the threshold; rows without a text take no place."""
    rng = random.Random(3)
    texts = [fx.prose(rng, 40) + (" awful vile words" if i % 4 == 0 else "") for i in range(400)]
    texts += [fx.prose(rng, 3000) for _ in range(20)]
    rows = [(i, t, "en", "s", None) for i, t in enumerate(texts)]
    labels = spark.createDataFrame([(i, int(i < 400 and i % 4 == 0)) for i in range(-600, 420)], "doc_id long, toxic int")
    docs = fx.documents(spark, rows)
    free = [i for i in range(420) if zlib.crc32(str(i).encode()) % 5]
    sample, _ = toxic_gru.labelled_sample(docs, labels, max_rows=200, max_chars=2000)
    assert len(sample) == 200 and any(1900 < len(t) <= 2100 for t in sample)
    model = toxic_gru.fit_toxicity(docs, labels, max_rows=200, max_chars=2000)
    counts = toxic_gru.score_bins(docs, labels, model, [])
    assert sum(counts.values()) == len(free)
    scored = toxic_gru.score_toxicity(docs, model, keep=["doc_id"]).toPandas().set_index("doc_id")["_score"]
    assert (scored.loc[400:] < 0.5).mean() > 0.9
    assert {(b >= 0, y): 0 for b, y in counts} and sum(n for (b, _), n in counts.items() if b >= 0) == (scored.loc[free] >= 0.5).sum()


# --- op9


def test_water_fill(spark):
    assert water(spark, [10, 10, 10], [3, 1, 2], 45) == [20, Fraction(25, 3), Fraction(50, 3)]
    assert water(spark, [1, 100, 100], [3, 1, 2], Fraction(603, 2)) == [2, Fraction(599, 6), Fraction(599, 3)]
    assert water(spark, [0, 5], [3, 1], 7) == [0, 7] and water(spark, [], [], 0) == [] and water(spark, [0], [1], 0) == [0]


def water(spark, sizes, weights, budget):
    sources = spark.createDataFrame([(i, n, w) for i, (n, w) in enumerate(zip(sizes, weights))], "_source int, n long, w int")
    rows = mix_fill.water_fill(sources, Fraction(budget), 2).orderBy("_source").collect()
    return pytest.approx([Fraction(r["target"]) for r in rows])


def test_mix(spark, odd):
    sized, plan = mix_fill.mix_sources(odd)
    plans = {r["_source"]: r for r in plan.collect()}
    rows = [(*r[:2], r[3], len(fx.WORD.findall(r[1] or ""))) for r in fx.odd_documents()]
    assert set(plans) == {r[2] for r in rows}
    mixed = mix_fill.mixed_documents(odd)
    assert mixed.columns == odd.columns
    taken = collections.Counter((r["doc_id"], r["text"], r["source"]) for r in mixed.collect())
    stands = collections.Counter(r[:3] for r in rows)
    for source, p in plans.items():
        own = [r for r in rows if r[2] == source]
        assert p["source_size"] == sum(r[3] for r in own) and p["target"] <= 2 * p["source_size"]
        got = sum(n * len(fx.WORD.findall(k[1] or "")) for k, n in taken.items() if k[2] == source)
        assert abs(got - p["target"]) <= max(r[3] for r in own)
    assert all(n <= 2 * stands[k] for k, n in taken.items())
    assert sum(p["target"] for p in plans.values()) == pytest.approx(1.5 * sum(r[3] for r in rows))
    again = collections.Counter((r["doc_id"], r["text"], r["source"]) for r in mix_fill.mixed_documents(odd.repartition(3)).collect())
    assert again == taken
    assert mix_fill.mixed_documents(empty(spark)).count() == 0


# --- op10


def test_signature_is_unbiased():
    rng = np.random.default_rng(3)
    keys = rng.integers(1, 1 << 62, 60).astype(np.uint64)
    a, b = rng.integers(0, 40, 60), rng.integers(0, 40, 60)
    a[:20] = b[:20]
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    doc = np.concatenate((np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)))
    s = bag_minhash.signatures(doc, np.concatenate((keys[a > 0], keys[b > 0])), np.concatenate((a[a > 0], b[b > 0])), 2, size=4096)
    assert np.isfinite(s).all()
    assert (s[0] == s[1]).mean() == pytest.approx(want, abs=0.04)
    single = bag_minhash.signatures(np.zeros(1, int), keys[:1], np.ones(1, int), 1)
    assert np.isfinite(single).all()


def classes(df):
    return {(r["doc_id"], r["class_id"]) for r in df.collect()}


def test_near_classes_on_odd_rows(spark, odd):
    got = bag_minhash.near_classes(odd)
    assert got.count() == odd.count()
    want = brute_classes = fx.brute_classes([r[:2] for r in fx.odd_documents()])
    assert {x for x in classes(got) if x[0] is not None} == set(want.items())
    assert brute_classes[7] == 5 and brute_classes[6] == 5
    kept = bag_minhash.keep_one_per_class(odd)
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(set(want.values())) and ids.count(None) == 1  # the other is near document 5
    assert set(kept.columns) == set(odd.columns)
    assert bag_minhash.near_classes(empty(spark)).count() == 0


def test_near_classes_on_the_small_table(spark, texts):
    got = entry.queries()["op10_near_dedup"](spark, SF)
    assert classes(got) == set(fx.brute_classes(texts).items())


def test_chains_and_groups_around_the_threshold(spark):
    """Groups whose members are close to each other, but not to one leader, and chains."""
    rng = random.Random(11)
    rows = []
    for group in range(6):
        words = fx.prose(rng, 160, 5000).split()
        for i in range(25):
            own = list(words)
            for _ in range(rng.randrange(6)):
                own[rng.randrange(len(own))] = f"x{rng.randrange(99999)}"
            rows.append((len(rows), " ".join(own)))
        for i in range(12):  # a chain: each a little further on
            words = words[6:] + fx.prose(rng, 6, 5000).split()
            rows.append((len(rows), " ".join(words)))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = fx.brute_classes(rows)
    assert 6 <= len(set(want.values())) < len(rows)
    assert classes(bag_minhash.near_classes(docs)) == set(want.items())


def test_connected_classes(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 102), (101, 102), (103, 101)]
    random.Random(1).shuffle(edges)
    got = bag_minhash.connected_classes(spark.createDataFrame(edges, "a long, b long"))
    assert {(r["node"], r["class"]) for r in got.collect()} == {*((i, 0) for i in range(41)), *((i, 100) for i in range(100, 104))}
