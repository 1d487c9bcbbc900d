"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Training reads a bounded sample of labelled rows (`SAMPLE`, in the order of a hash of their ids) in
one task; the L1 term leaves few weights, which are broadcast. Scoring is one pass over the texts
without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exprspark.llm import common, hashing

#: Labelled documents that training uses at most.
SAMPLE = 12_000
GRAMS = ((0,), (0, 1), (0, 2))
ALPHA, BETA, L1, L2, EPOCHS = 5.0, 1.0, 4.0, 0.1, 4


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(owner, 32-bit feature), each feature once per text: words, word pairs, and pairs that skip one word."""
    owner, words = hashing.word_hashes(texts)
    parts = [hashing.windows(owner, words, offsets) for offsets in GRAMS]
    key = np.concatenate([(o.astype(np.uint64) << np.uint64(32)) | (v >> np.uint64(32)) for o, v in parts])
    key = np.unique(key)
    return (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def fit(texts: list[bytes], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(sorted features, weights, bias) after `EPOCHS` passes of per-coordinate FTRL-proximal updates (McMahan et al. 2013).

    A feature of one document only is left out of the arrays: its `EPOCHS` gradients, each below 1,
    cannot pass L1, so its weight is 0 anyway. The bias starts from the smoothed share of label 1 and is not penalised.
    """
    positive = float(labels.sum())
    prior = (positive + 1) / (len(labels) + 10)
    base = float(np.log(prior / (1 - prior)))
    owners, values, size, first = [], [], 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size > common.SLICE_BYTES or i == len(texts) - 1:
            owner, value = features(texts[first : i + 1])
            owners.append((owner + first).astype(np.int32)), values.append(value)
            first, size = i + 1, 0
    if not owners:
        return np.empty(0, np.uint32), np.empty(0), base
    every = np.concatenate(values)
    every.sort()
    known = np.unique(every[1:][every[1:] == every[:-1]])
    del every
    held = []
    for k, value in enumerate(values):  # part by part: only places of shared features outlive it
        place = np.searchsorted(known, value)
        keep = place < len(known)
        keep[keep] = known[place[keep]] == value[keep]
        held.append((owners[k][keep], place[keep].astype(np.int32)))
        values[k] = None
    owner, place = (np.concatenate([h[c] for h in held]) for c in (0, 1))
    first = np.searchsorted(owner, np.arange(len(texts) + 1))
    z, n = np.zeros(len(known)), np.zeros(len(known))
    zb = nb = 0.0

    def weight(z, n):
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for i, y in enumerate(labels):
            at = place[first[i] : first[i + 1]]
            own_z, own_n = z[at], n[at]
            w, wb = weight(own_z, own_n), -zb / ((BETA + nb**0.5) / ALPHA)
            p = 1 / (1 + np.exp(-np.clip(w.sum() + wb + base, -35, 35)))
            g = float(p - y)
            step = (np.sqrt(own_n + g * g) - np.sqrt(own_n)) / ALPHA
            z[at], n[at] = own_z + g - step * w, own_n + g * g
            zb, nb = zb + g - ((nb + g * g) ** 0.5 - nb**0.5) / ALPHA * wb, nb + g * g
    w = weight(z, n)
    kept = w != 0
    return known[kept], w[kept], float(base - zb / ((BETA + nb**0.5) / ALPHA))


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = pa.Table.from_batches(batches, pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("toxic", pa.int32())])).to_pandas()
    order = np.argsort(hashing.mix(rows["doc_id"].to_numpy(np.int64).view(np.uint64)), kind="stable")
    texts = [(rows["text"].iloc[i] or "").encode() for i in order]
    known, weights, bias = fit(texts, rows["toxic"].to_numpy(np.float64)[order])
    yield pa.RecordBatch.from_arrays([pa.array([-1, *known.tolist()], pa.int64()), pa.array([bias, *weights.tolist()], pa.float64())], names=["feature", "weight"])


def held_out(doc_id: str = "doc_id"):
    """Rows never learned from: crc32 of the id's digits divisible by 5. A null id counts as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> pd.DataFrame:
    """Weights (feature, weight; feature -1 is the bias) learned from at most `sample` labelled rows outside the held-out fold.

    Rows whose label or id is null are not used; of labels that disagree on one document, 1 counts.
    The sample is the rows with the smallest hash of the id, so it does not depend on partitioning.
    """
    known = labels.where("toxic is not null").where(~held_out()).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")  # at most `sample` rows of two numbers
    rows = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    return rows.repartition(1).mapInArrow(_train, "feature bigint, weight double").toPandas()


def scored(docs: DataFrame, weights: pd.DataFrame, columns: list[str], name: str = "score") -> DataFrame:
    """The named columns of docs and the score. A null or empty text scores by the bias alone."""
    bias = float(weights.loc[weights["feature"] < 0, "weight"].sum())
    own = weights[weights["feature"] >= 0].sort_values("feature")
    model = docs.sparkSession.sparkContext.broadcast((own["feature"].to_numpy(np.uint32), own["weight"].to_numpy(np.float64)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weight = model.value
        marked = np.zeros(1 << 16, bool)
        marked[known >> np.uint32(16)] = True
        for batch in batches:
            for part in common.slices(batch):
                owner, words = hashing.word_hashes(common.encoded(part.column("text")))
                hits = []
                for offsets in GRAMS:
                    holder, value = hashing.windows(owner, words, offsets)
                    value = (value >> np.uint64(32)).astype(np.uint32)
                    near = marked[value >> np.uint32(16)]
                    holder, value = holder[near], value[near]
                    place = np.minimum(np.searchsorted(known, value), max(len(known) - 1, 0))
                    same = known[place] == value if len(known) else np.zeros(0, bool)
                    hits.append(holder[same] * np.int64(len(known) + 1) + place[same])
                once = np.unique(np.concatenate(hits))
                total = np.bincount(once // (len(known) + 1), weight[once % (len(known) + 1)] if len(known) else None, minlength=part.num_rows)
                value = 1 / (1 + np.exp(-np.clip(total + bias, -35, 35)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(value, pa.float64())], names=[*columns, name])

    held = docs.select(*columns, *([] if "text" in columns else ["text"]))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema if f.name in columns), f"`{name}` double"])
    return held.mapInArrow(score, schema)


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from 0.5 on) of every row. Without labelled rows the score is that of a rare label."""
    scores = scored(docs, train(docs, labels, sample), ["doc_id"])
    return scores.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
