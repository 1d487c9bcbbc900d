"""Dual-tree search against a plain scan."""

import math
import random
import re
from collections import Counter

import numpy as np

from exprspark.llm import dualtree


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, top=10):
    held = [(i, words(t)) for i, t in docs]
    held = [(i, w) for i, w in held if w]
    total, length = len(held), sum(len(w) for _, w in held)
    counts = [Counter(w) for _, w in held]
    frequency = Counter(t for c in counts for t in c)
    out = []
    for item_id, text in items:
        scored = []
        for (doc_id, w), c in zip(held, counts):
            m = 10 + 90 * len(w) * total // length
            score = 0
            for t in set(words(text)):
                df, tf = frequency[t], c[t]
                score += math.floor(1000 * math.log((2 * total + 2) / (2 * df + 1))) * (10**9 * tf // (1000 * tf + 8 * m)) if df else 0
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0))
        out += [(item_id, k, None if null else i, -s) for k, (s, null, i) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


def ours(spark, docs, items, top=10):
    got = dualtree.ranked_search(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), spark.createDataFrame(items, "item_id bigint, text string"), top)
    return sorted([tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()], key=str)


def sentence(rng, words_, n):
    return " ".join(words_[min(int(rng.expovariate(0.05)), len(words_) - 1)] for _ in range(n))


def test_equals_a_plain_scan(spark):
    rng = random.Random(3)
    known = [f"w{k}é" if k % 3 else f"W{k}" for k in range(200)]
    docs = [(i, sentence(rng, known, rng.randint(0, 40))) for i in range(300)]
    docs += [(1000 + i, docs[5][1]) for i in range(30)] + [(7, docs[5][1]), (7, docs[5][1]), (None, docs[5][1]), (None, None), (2000, ""), (2001, "?! --"), (2002, "w1é " * 20_000)]
    items = [(i, sentence(rng, known, 8)) for i in range(40)] + [(40, docs[5][1]), (40, docs[5][1]), (None, "w1é, W1É"), (41, None), (42, "zzz"), (43, ".")]
    assert ours(spark, docs, items) == plain(docs, items)


def test_several_groups_of_items_and_short_lists(spark, monkeypatch):
    monkeypatch.setattr(dualtree, "GROUP_TERMS", 12)
    docs = [(1, "a b c"), (2, "a b"), (3, "d"), (4, "a b c")]
    items = [(k, t) for k, t in enumerate(["a c", "d e f g h i j k l m n o", "b", "c d"])]
    assert ours(spark, docs, items, 2) == plain(docs, items, 2)


def test_empty_tables_and_other_columns(spark):
    docs, items = [(1, "a b c")], [(1, "a")]
    assert ours(spark, [], items) == [] and ours(spark, docs, []) == [] and ours(spark, [(1, None)], items) == []
    wide = spark.createDataFrame([(1, "a b", 3, 4, 5)], "doc_id bigint, text string, n int, score int, terms int")
    assert dualtree.ranked_search(wide, spark.createDataFrame([(9, "a", 1, 2)], "item_id int, text string, rank int, item int")).count() == 1


def test_pruning_leaves_most_documents_unscored():
    rng = np.random.default_rng(2)
    width, docs = 400, 24000
    owner = np.repeat(np.arange(docs), 12)
    term = (rng.integers(0, 8, docs)[owner] * 50 + rng.integers(0, 50, len(owner))).astype(np.int64)
    key = np.unique(owner * width + term)
    owner, term = key // width, key % width
    impact, weights = (1000 * rng.random(len(owner)) ** 4).astype(np.int64) + 1, rng.integers(1, 50, width)
    items = [sorted(rng.choice(50, 3, replace=False) + 50 * int(rng.integers(0, 8))) for _ in range(60)]
    tree = dualtree.ItemTree(items, weights, np.bincount(term, minlength=width))
    search = dualtree.Search(tree, np.ones(60, np.int64), 10)
    for at in range(0, docs, 4000):
        mine = (owner >= at) & (owner < at + 4000)
        search.feed(list(range(at, at + 4000)), dualtree.DocumentTree(owner[mine] - at, term[mine], impact[mine], weights))
    dense = np.zeros((docs, width), np.int64)
    dense[owner, term] = impact
    for place, item in enumerate(tree.order):
        score = dense[:, items[item]] @ weights[items[item]]
        assert search.lists[place] == sorted((-int(s), False, d) for d, s in enumerate(score) if s)[:10]
    full = sum(int((dense[:, i] > 0).any(1).sum()) for i in items)
    assert search.scored < 0.5 * full
