"""The stages, one after the other, each held against brute force on its own input."""

import random
import zlib
from collections import Counter

import pytest

import __spark_entry__ as entry_module
import corpus_pipeline
from exprspark.llm import decontam, toxicity
from test_documents import BENCH, expected_targets, prose, shingles, words


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """documents with an extra column that is named like an operator's, labels, benchmark."""
    path = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(8)
    docs = []
    for i in range(700):
        text = prose(i, rng.randint(20, 60))
        if i % 10 == 0:
            text += f" {rng.choice(['vile', 'scum'])} " + prose(i + 5000, 9)
        if i % 23 == 1:
            text = prose(1, 50).replace("a", "b", i % 3)
        if i % 31 == 2:
            text += " " + BENCH[0][1] + " " + prose(i + 7000, 5)
        docs.append((i, text, "en", ["a", "b", "c", None][min(3, rng.randint(0, 9))], len(text), 0.5, i))
    docs += [(900, None, None, "a", None, None, None), (901, "", "en", "b", 0, None, None), (None, prose(999, 30), "en", "a", 1, None, None), (None, prose(999, 30), "en", "a", 1, None, None), (3, *docs[3][1:])]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, root int").repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 10 == 0)) for i in range(700)], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(BENCH, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_do_what_they_say(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        out.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        assert name == "sharding" or after.columns == columns
        seen.append((name, docs, after))
        docs = after
    assert [n for n, _, _ in seen] == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    data = {n: ([tuple(r) for r in a.collect()], [tuple(r) for r in b.collect()]) for n, a, b in seen}

    before, after = data["toxicity"]
    gone = Counter(before) - Counter(after)
    assert not Counter(after) - Counter(before) and all(r[0] is not None and r[0] % 10 == 0 for r in gone)
    held = [r for r in before if r[0] is not None and r[0] % 10 == 0 and zlib.crc32(str(r[0]).encode()) % 5 == 0 and ("vile" in words(r[1]) or "scum" in words(r[1]))]
    assert sum(r in gone for r in held) >= 0.8 * len(held)

    before, after = data["near_duplicates"]
    sets = [shingles(r[1]) for r in before]
    parent = list(range(len(before)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(before)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(before):
        key = find(i) if sets[i] else ("blank", r[0], r[1])
        groups.setdefault(key, []).append(r)
    first = Counter(min((r[0] for r in g if r[0] is not None), default=None) for g in groups.values())
    assert Counter(r[0] for r in after) == first and not Counter(after) - Counter(before)

    before, after = data["decontamination"]
    leaked = [r for r in before if r[1] and BENCH[0][1].lower() in r[1].lower()]
    assert leaked and Counter(before) - Counter(after) == Counter(leaked)

    before, after = data["mixing"]
    sizes = Counter()
    for r in before:
        sizes[r[3]] += len(words(r[1]))
    want, taken, times = expected_targets(sizes), Counter(), Counter(after)
    for r, n in times.items():
        assert r in before and n <= 3
        taken[r[3]] += n * len(words(r[1]))
    assert all(abs(taken[s] - want[s]) <= 80 for s in want)

    before, after = data["sharding"]
    assert Counter(r[0] for r in before) == Counter(r[0] for r in after)
    counts = Counter(r[4] for r in after)
    assert max(counts.values()) - min(counts.values()) <= 1 and set(counts) == set(range(8))


def test_the_whole_pipeline_is_registered(spark):
    assert entry_module.queries()["pipeline"] is corpus_pipeline.run
    base = "/root/testdata/sf0.001"
    got = corpus_pipeline.run(spark, base)
    assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"] and got.count() > 0


def test_held_out_toxic_documents_are_found(spark):
    base = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{base}/labels.parquet")
    got = toxicity.toxicity(spark.read.parquet(f"{base}/documents.parquet"), labels).join(labels, "doc_id").where("held_out").toPandas()
    found = got[got.predicted == 1]  # 3,200 rows to learn from; with 12,000 no clean document was marked
    assert (found.toxic == 1).mean() > 0.9 and len(found) >= 0.7 * (got.toxic == 1).sum()


def test_benchmark_passages_are_found_on_the_driver_tables(spark):
    base = "/root/testdata/sf0.01"
    docs, bench = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/benchmark.parquet")
    plain = {r.item_id: " ".join(words(r.text.lower())) for r in bench.collect()}
    want = {r.doc_id for r in docs.collect() if any(p in " ".join(words((r.text or "").lower())) for p in plain.values())}
    assert want <= {r.doc_id for r in decontam.leaks(docs, bench).collect()}
