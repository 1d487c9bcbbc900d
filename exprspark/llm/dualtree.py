"""Ranked lexical search by a dual tree.

Items form a hierarchy of nodes, each with the union of its items' terms; documents form one in batches, whose nodes hold for every
term the largest impact (the document part of the score) of any document below. A pair of an item node and a document
node is bounded by the sum of term weight times largest impact. Where that is below the weakest kth score among the node's
items, no document below can enter any of their lists, so the whole pair is dropped; otherwise both
sides are opened. The lists of a task live through all its batches. They start from kth scores reached
in a sixty-fourth of the documents, which only bound from below: every document is searched.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from exprspark.llm import common
from exprspark.session import cut

TOP = 10
#: Terms are runs of ASCII letters and digits and of anything beyond ASCII; in UTF-8 the latter are the bytes from 0x80.
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: Items are searched in groups of about this many terms, which bounds what is broadcast to some 100 MB.
GROUP_TERMS = 1_000_000
FAN = 8
LEAF, SPREAD, BATCH = 4, 16, 4096
SEED_PARTS = 64


def terms(text: bytes) -> list[bytes]:
    return TERM.findall(text.lower())


def term_vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms with repeats), and the counts of the vocabulary's terms, of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for part in common.slices(batch):
                n, ids, times = [], [], []
                for text in common.encoded(part.column("text")):
                    held = Counter(terms(text))
                    mine = [(known[t], c) for t, c in held.items() if t in known]
                    n.append(held.total())
                    ids.append([t for t, _ in mine])
                    times.append([c for _, c in mine])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int64()))],
                                                 names=["doc_id", "n", "terms", "times"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(count, "doc_id bigint, n bigint, terms array<int>, times array<bigint>")


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


class ItemTree:
    """Levels of nodes from single items upwards; a node has its terms, and at what range of items."""

    def __init__(self, items: list[list[int]], weights: np.ndarray, frequency: np.ndarray):
        # items that share their most common words stand together
        self.order = sorted(range(len(items)), key=lambda i: sorted((-int(frequency[t]), t) for t in items[i]))
        self.weights = weights
        self.levels = [[np.array(sorted(items[i]), np.int64) for i in self.order]]
        while len(self.levels[-1]) > FAN:
            below = self.levels[-1]
            self.levels.append([reduce(np.union1d, below[k : k + FAN]) for k in range(0, len(below), FAN)])

    def span(self, level: int, node: int) -> slice:
        return slice(node * FAN**level, (node + 1) * FAN**level)

    def children(self, level: int, node: int) -> range:
        return range(node * FAN, min((node + 1) * FAN, len(self.levels[level - 1])))


class DocumentTree:
    """Three levels over a batch of documents: leaves of `LEAF`, nodes of `SPREAD` leaves, the batch."""

    def __init__(self, owner: np.ndarray, term: np.ndarray, impact: np.ndarray, weights: np.ndarray):
        # documents with the same heaviest term stand together, the highest impacts first
        heavy = impact * weights[term]
        best = np.lexsort((-heavy, owner))
        docs, at = np.unique(owner[best], return_index=True)
        lead = best[at]
        self.documents = docs[np.lexsort((-heavy[lead], term[lead]))]
        place = np.empty(int(owner.max(initial=-1)) + 1, np.int64)
        place[self.documents] = np.arange(len(self.documents))
        self.width = len(weights)
        key = place[owner] // LEAF * self.width + term
        order = np.argsort(key, kind="stable")
        self.place, self.impact = place[owner][order], impact[order]
        keys, self.first = np.unique(key[order], return_index=True)
        self.first = np.append(self.first, len(order))
        self.levels = [(keys, np.maximum.reduceat(self.impact, self.first[:-1]) if len(keys) else self.impact)]
        for _ in range(2):
            keys, most = self.levels[-1]
            above = keys // self.width // SPREAD * self.width + keys % self.width
            order = np.argsort(above, kind="stable")
            keys, first = np.unique(above[order], return_index=True)
            self.levels.append((keys, np.maximum.reduceat(most[order], first) if len(keys) else most))
        self.sizes = [-(-len(self.documents) // (LEAF * SPREAD**h)) for h in range(3)]

    def _find(self, level: int, nodes: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = self.levels[level][0]
        wanted = nodes[:, None] * self.width + term[None, :]
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return at, keys[at] == wanted

    def bounds(self, level: int, nodes: np.ndarray, term: np.ndarray, weights: np.ndarray) -> np.ndarray:
        at, hit = self._find(level, nodes, term)
        return np.where(hit, self.levels[level][1][at], 0) @ weights

    def scores(self, leaves: np.ndarray, term: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document, exact score) of the documents of some leaves that hold any of the terms."""
        at, hit = self._find(0, leaves, term)
        at, factor = at[hit], np.broadcast_to(weights, hit.shape)[hit]
        size = self.first[at + 1] - self.first[at]
        entry = np.repeat(self.first[at] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        docs, back = np.unique(self.place[entry], return_inverse=True)
        total = np.zeros(len(docs), np.int64)
        np.add.at(total, back, self.impact[entry] * np.repeat(factor, size))
        return self.documents[docs], total


class Search:
    """Lists of the best documents of every item of a tree, fed batch by batch."""

    def __init__(self, tree: ItemTree, floor: np.ndarray, top: int):
        self.tree, self.top = tree, top
        self.weakest = floor.copy()  # of an item: the score that a document needs at least
        self.lists: list[list[tuple[int, bool, int]]] = [[] for _ in tree.order]
        self.scored = 0

    def feed(self, doc_ids: list[int | None], batch: DocumentTree) -> None:
        self.doc_ids, self.batch = doc_ids, batch
        if not len(batch.documents):
            return
        top = len(self.tree.levels) - 1
        for node in range(len(self.tree.levels[top])):
            self._pair(top, node, 2, np.arange(batch.sizes[2]))

    def _pair(self, level: int, node: int, height: int, nodes: np.ndarray) -> None:
        term = self.tree.levels[level][node]
        weights = self.tree.weights[term]
        nodes = nodes[self.batch.bounds(height, nodes, term, weights) >= self.weakest[self.tree.span(level, node)].min()]
        if not len(nodes):
            return
        if not level and not height:
            self._score(node, nodes, term, weights)
            return
        if height:
            height -= 1
            nodes = (nodes[:, None] * SPREAD + np.arange(SPREAD)).ravel()
            nodes = nodes[nodes < self.batch.sizes[height]]
        for child in self.tree.children(level, node) if level else [node]:
            self._pair(max(level - 1, 0), child, height, nodes)

    def _score(self, item: int, leaves: np.ndarray, term: np.ndarray, weights: np.ndarray) -> None:
        docs, score = self.batch.scores(leaves, term, weights)
        self.scored += len(docs)
        good = score >= self.weakest[item]
        found = [(-s, (i := self.doc_ids[d]) is None, i or 0) for d, s in zip(docs[good].tolist(), score[good].tolist())]
        if found:
            self.lists[item] = sorted(self.lists[item] + found)[: self.top]
            if len(self.lists[item]) == self.top:
                self.weakest[item] = max(self.weakest[item], -self.lists[item][-1][0])

    def rows(self) -> pa.RecordBatch:
        found = [(self.tree.order[k], None if null else i, -s) for k, own in enumerate(self.lists) for s, null, i in own]
        return pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], t) for c, t in enumerate((pa.int32(), pa.int64(), pa.int64()))], names=["item", "doc_id", "score"])


def batch_tree(part: pa.RecordBatch, documents: int, length: int, weights: np.ndarray) -> DocumentTree:
    n = part.column("n").to_pylist()
    m = np.array([10 + 90 * x * documents // length for x in n], np.int64)
    counts = np.array([len(x) for x in part.column("terms").to_pylist()], np.int64)
    owner = np.repeat(np.arange(len(counts)), counts)
    term, times = (part.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("terms", "times"))
    return DocumentTree(owner, term, 1_000_000_000 * times // (1000 * times + 8 * m[owner]), weights)


def _searcher(shared, floor: np.ndarray, documents: int, length: int, top: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        search = Search(tree, floor[tree.order], top)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                search.feed(part.column("doc_id").to_pylist(), batch_tree(part, documents, length, tree.weights))
        yield search.rows()

    return work


def _ranked(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _group(docs: DataFrame, group: list[tuple[int | None, list[bytes]]], top: int) -> DataFrame:
    spark = docs.sparkSession
    words = sorted({t for _, held in group for t in held})
    vocabulary = {t: k for k, t in enumerate(words)}
    table = cut(term_vectors(docs, vocabulary))
    size = table.where("n > 0").agg(F.count(F.lit(1)), F.sum(F.col("n").cast("decimal(38,0)"))).first()
    documents, length = size[0], int(size[1] or 0)
    frequency = np.zeros(len(words), np.int64)
    for r in table.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # one row per item term of the group
        frequency[r["t"]] = r["count"]
    weights = np.array([weight(documents, int(f)) for f in frequency], np.int64)
    items = [[vocabulary[t] for t in held] for _, held in group]
    shared = spark.sparkContext.broadcast(ItemTree(items, weights, frequency))
    table = table.where("size(terms) > 0")
    schema = "item int, doc_id bigint, score bigint"
    floor = np.ones(len(group), np.int64)
    seeds = table.where(F.pmod(F.xxhash64("doc_id", "n"), F.lit(SEED_PARTS)) == 0).mapInArrow(_searcher(shared, floor, documents, length, top), schema)
    for r in _ranked(seeds, top).where(F.col("rank") == top).collect():  # one row per item of the group
        floor[r["item"]] = r["score"]
    found = _ranked(table.mapInArrow(_searcher(shared, floor, documents, length, top), schema), top)
    names = spark.createDataFrame([(k, item_id) for k, (item_id, _) in enumerate(group)], "item int, item_id bigint")
    return found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")  # as many rows as the group has items


def ranked_search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the `top` best documents of every row of items (item_id, text) by a BM25 in integers.

    Equal scores rank by ascending doc_id, a null one last. Documents score only above 0. Null and empty texts have no terms: such
    documents count for nothing, such items get no rows. Repeated rows of docs are ranked one by one, repeated rows of items
    each give a list. Empty tables give no rows. Other columns are ignored. Items are read in groups of about a million terms.
    """
    result: DataFrame | None = None
    group: list[tuple[int | None, list[bytes]]] = []
    held = 0

    def finish() -> None:
        nonlocal result, group, held
        part = _group(docs, group, top)
        result = part if result is None else result.unionByName(cut(part))
        group, held = [], 0

    for item in items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").toLocalIterator():
        mine = sorted(set(terms((item.text or "").encode())))
        if mine:
            group.append((item.item_id, mine))
            held += len(mine)
        if held >= GROUP_TERMS:
            finish()
    if group:
        finish()
    if result is None:
        return docs.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    return result
