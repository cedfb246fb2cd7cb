"""Spelling variants: words one edit apart, found by walking a trie as a relation, level by level.

The trie of all words is a table of edges (node, label, child); chains without a branch or a word's end are one edge, so long
words cost few levels. A node is named by the hash of its prefix. The frontier is a table of states (word, position, node,
edits); a level joins it with the edges of its nodes, takes each label with or without one edit, and keeps the states that
can go on. States with one edit that end with the word on a word's node are its neighbours.

An edit lies in the front or in the back half of a word. Words and reversed words make two tries, and in each of them a
word starts at its deepest node of its front half, where few branches are left: an edit in the front half is one in the back
half of the reversed word. So no state stands near a root, where each word would meet each branch.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import discard, written

#: Prefixes up to this length are nodes without being counted; all words share a few of them.
TOP = 2


def word_counts(words: DataFrame, word: str = "word", min_length: int = 5, min_count: int = 3) -> DataFrame:
    """(word, n): words of enough code points that occur often enough; null words are left out."""
    counted = words.select(F.col(word).alias("word")).filter(F.char_length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") >= min_count)


def _node(side: Column, text: Column, length: Column) -> Column:
    return F.xxhash64(side, F.substring(text, F.lit(1), length))


def trie_paths(words: DataFrame) -> DataFrame:
    """(side, s, stops): each word, forward and reversed, with the lengths of its prefixes that are nodes, 0 and its own included."""
    length = F.char_length("s")
    both = words.select(F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.col("word").alias("s")), F.struct(F.lit(1).alias("side"), F.reverse("word").alias("s")))).alias("e")).select("e.*")
    # words travel as hashes here, so a long word does not stand in each of its prefixes
    inside = both.select(F.xxhash64("side", "s").alias("w"), "side", "s", F.explode(F.sequence(F.lit(TOP + 1), F.greatest(length - 1, F.lit(TOP + 1)))).alias("p"))
    following = F.when(F.col("p") < length, F.xxhash64(F.substring(F.col("s"), F.col("p") + 1, F.lit(1))))
    inside = inside.select("w", "p", _node(F.col("side"), F.col("s"), F.col("p")).alias("h"), following.alias("c"))
    branching = inside.groupBy("h").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("h")
    nodes = branching.unionByName(both.select(F.xxhash64("side", "s").alias("h"))).distinct().withColumnRenamed("h", "_h")
    stops = inside.join(nodes, F.col("h") == F.col("_h"), "left_semi").groupBy("w").agg(F.collect_set("p").alias("found"))
    top = F.filter(F.sequence(F.lit(0), F.lit(TOP)), lambda p: p < length)
    inner = F.filter(F.coalesce("found", F.array().cast("array<int>")), lambda p: p < length)
    return both.join(stops, F.xxhash64("side", "s") == F.col("w"), "left").select("side", "s", F.sort_array(F.concat(top, inner, F.array(length))).alias("stops"))


def trie_edges(paths: DataFrame) -> DataFrame:
    """(node, label, child, ends, nexts): ``ends`` 1 if a word ends at the child, ``nexts`` the first letters of its own edges."""
    steps = paths.select("side", "s", "stops", F.posexplode("stops").alias("i", "lo")).withColumn("hi", F.get("stops", F.col("i") + 1)).filter("hi is not null")
    edges = steps.select(
        _node(F.col("side"), F.col("s"), F.col("lo")).alias("node"), F.substring(F.col("s"), F.col("lo") + 1, F.col("hi") - F.col("lo")).alias("label"),
        _node(F.col("side"), F.col("s"), F.col("hi")).alias("child"), (F.col("hi") == F.char_length("s")).cast("int").alias("ends"))
    edges = written(edges.groupBy("node", "label", "child").agg(F.max("ends").alias("ends")), "trie-edges")
    letters = edges.groupBy(F.col("node").alias("_n")).agg(F.array_join(F.collect_set(F.substring("label", 1, 1)), "").alias("nexts"))
    whole = written(edges.join(letters, F.col("child") == F.col("_n"), "left").select("node", "label", "child", "ends", F.coalesce("nexts", F.lit("")).alias("nexts")), "trie-edges")
    discard(edges)
    return whole


def _crossed(states: DataFrame, edges: DataFrame, ways: list[Column]) -> DataFrame:
    """States of one edit behind the edges of their nodes: ``ways`` are structs (p, or null where the label cannot be taken so).

    A state that cannot go on is left out at once: the word's next letter must lead on from the child, or both must end."""
    length = F.char_length("s")
    at = states.join(edges.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"))
    leads = lambda p: F.when(p == length, F.col("ends") == 1).otherwise(F.col("nexts").contains(F.substring(F.col("s"), p + 1, F.lit(1))))
    live = [F.when(leads(p), p) for p in ways]
    at = at.filter(F.coalesce(*live).isNotNull()).select(
        "side", "s", F.concat("path", "label").alias("path"), F.col("child").alias("node"), F.explode(F.array(*live)).alias("p"))
    return at.filter("p is not null")


def _taken(n: Column) -> Column:
    return F.substring(F.col("s"), F.col("p") + 1, n)


def _edited(states: DataFrame, edges: DataFrame) -> DataFrame:
    """The one edit inside the label of an edge: a letter replaced, one too many in the word, or one too few."""
    size = F.char_length("label")

    letter = lambda k: F.substring(F.col("s"), F.col("p") + k, F.lit(1)) == F.col("label")

    def way(n, of_one):
        one = F.when(size == 1, of_one).otherwise(F.levenshtein(_taken(n), F.col("label"), 1) == 1)
        return F.when((F.char_length("s") >= F.col("p") + n) & one, F.col("p") + n)

    # most labels are one letter
    return _crossed(states, edges, [way(size, ~letter(1)), way(size + 1, letter(1) | letter(2)), way(size - 1, F.lit(True))])


def _followed(states: DataFrame, edges: DataFrame) -> DataFrame:
    """No further edit: the label stands in the word."""
    size = F.char_length("label")
    return _crossed(states, edges, [F.when(_taken(size) == F.col("label"), F.col("p") + size)])


def near_words(words: DataFrame) -> DataFrame:
    """(word, near): every ordered pair of words exactly one inserted, deleted or replaced code point apart.

    ``words`` holds distinct words in column ``word``. The states without an edit are a word's own nodes, known from its path, so
    they meet the edges together; then one job per level takes the states of one edit on. The number of levels is that
    of branches along the back half of a word. Nothing but the emptiness of a level comes to the driver."""
    paths = written(trie_paths(words), "trie-paths")
    edges = trie_edges(paths)
    length = F.char_length("s")
    start = F.array_max(F.filter("stops", lambda p: p <= F.floor(length / 2)))
    own = paths.withColumn("_start", start).select("side", "s", F.explode(F.filter("stops", lambda p: p >= F.col("_start"))).alias("p"))
    own = own.select("side", "s", "p", _node(F.col("side"), F.col("s"), F.col("p")).alias("node"), F.substring(F.col("s"), F.lit(1), F.col("p")).alias("path"))
    # the word without its last code point
    shorter = own.filter(F.col("p") == length - 1).select("side", "s", "path", "node").join(
        paths.select(F.xxhash64("side", "s").alias("_end")), F.col("node") == F.col("_end"), "left_semi").select("side", "s", "path")
    found, levels = [shorter], []
    level = _edited(own, edges)
    while True:
        levels.append(level := written(level, "trie-level"))
        found.append(level.filter(F.col("p") == length).select("side", "s", "path"))
        states = level.filter(F.col("p") < length)
        if states.isEmpty():
            break
        level = _followed(states, edges)
    forward = lambda c: F.when(F.col("side") == 0, F.col(c)).otherwise(F.reverse(c))
    pairs = reduce(DataFrame.unionByName, found).select(forward("s").alias("word"), forward("path").alias("near")).distinct()
    # hashes name the nodes: an equal hash of two prefixes could only add a pair, and this takes it out
    out = written(pairs.filter(F.levenshtein("word", "near", 1) == 1), "trie-pairs")
    discard(paths, edges, *levels)
    return out


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms followed to the last; each round doubles the way gone."""
    roots = written(forms.select("word", F.col("form").alias("root")), "trie-roots")
    while True:
        on = roots.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        after = written(roots.join(on, F.col("root") == F.col("_word"), "left").select(
            "word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved")), "trie-roots")
        discard(roots)
        roots = after
        if roots.filter("moved").isEmpty():
            return roots.select("word", "root")


def spelling_groups(words: DataFrame, word: str = "word", min_length: int = 5, min_count: int = 3, ratio: int = 2) -> DataFrame:
    """Frequent words with the commoner spelling each is taken for: (word, form, root, n, n_near, form_n).

    ``words`` has a row per occurrence. Words of at least ``min_length`` code points and ``min_count`` occurrences are compared; two
    are near if one inserted, deleted or replaced code point makes one the other. ``form`` is the near word of most occurrences
    (ties: the smallest in code-point order) if it has at least ``ratio`` times as many, else null; ``root`` the end of the chain of forms.

    * null and empty words are left out; ties in counts are settled by code-point order; repeated rows are occurrences
    * words of any length are compared whole; a word without near words has ``n_near`` 0, no form, and is its own root
    * an empty table gives no rows; other columns play no part, whatever their names
    """
    counts = written(word_counts(words, word, min_length, min_count), "trie-words")
    pairs = near_words(counts.select("word"))
    other = counts.select(F.col("word").alias("_near"), F.col("n").alias("near_n"))
    best = pairs.join(other, F.col("near") == F.col("_near")).groupBy(F.col("word").alias("_word")).agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near"))).alias("top"))
    common = -F.col("top.minus")
    chosen = written(
        counts.join(best, F.col("word") == F.col("_word"), "left").withColumn("fits", F.coalesce(common >= F.col("n") * ratio, F.lit(False))).select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("fits"), F.col("top.near")).alias("form"),
            F.when(F.col("fits"), common).alias("form_n")), "trie-forms")
    roots = _roots(chosen.filter("form is not null")).select(F.col("word").alias("_of"), "root")
    discard(counts, pairs)
    return chosen.join(roots, F.col("word") == F.col("_of"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
