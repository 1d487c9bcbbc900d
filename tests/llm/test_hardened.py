"""Broken media and clashing columns, and the sequential walk around the ring."""

import random

import numpy as np
import pytest

from exprspark.llm import licenses, sharding, tiff, toxicity


def test_no_changed_byte_of_a_file_raises():
    media = tiff.store(bytes(range(64)) * 2)
    for at in range(len(media)):
        for value in (0, 1, 127, 255, media[at] ^ 1):
            pages = list(tiff.read(media[:at] + bytes([value]) + media[at + 1 :]))
            assert pages and all(p.error is not None or p.data is not None for p in pages)
    for end in range(len(media)):
        list(tiff.read(media[:end]))


@pytest.mark.parametrize("name", ["near", "own_dir", "_own", "scan_at", "license"])
def test_license_scan_passes_columns_of_any_name(spark, name):
    files = spark.createDataFrame([("a/LICENSE", "Licensed under the Apache License, Version 2.0.", 1), ("a/b.txt", "words of no licence at all", 2), (None, None, 3)], f"path string, text string, `{name}` int")
    got = {r["path"]: r for r in licenses.scan(files).collect()}
    assert got["a/LICENSE"]["origin"] == "header" and got["a/b.txt"]["origin"] == "inherited" and got[None]["origin"] is None
    if name != "license":
        assert {got[p][name] for p in got} == {1, 2, 3}


def test_ring_equals_the_sequential_walk():
    """Documents one by one in ring order: first all that their own shard has room for, then the others, clockwise."""
    rng = np.random.default_rng(3)
    _, owner = sharding.ring(4, 8)
    counts = rng.integers(0, 40, len(owner))
    counts[5] = 500
    room = [int(counts.sum()) // 4 + (s < int(counts.sum()) % 4) for s in range(4)]
    want = {}
    later = []
    for arc, n in enumerate(counts.tolist()):
        for rank in range(n):
            if room[owner[arc]]:
                room[owner[arc]] -= 1
                want[arc, rank] = int(owner[arc])
            else:
                later.append((arc, rank))
    for arc, rank in later:
        step = arc
        while not room[owner[step]]:
            step = (step + 1) % len(owner)
        room[owner[step]] -= 1
        want[arc, rank] = int(owner[step])
    got = {(arc, rank): shard for arc, low, high, shard, _ in sharding.walk(counts, owner, 4) for rank in range(low, high)}
    assert got == want and not any(room)


def test_training_equals_a_loop_over_dictionaries():
    rng = random.Random(7)
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))).encode() for _ in range(80)] + [b"", b"once only words here"]
    labels = np.array([int(b"w1 " in t or b"w2 " in t) for t in texts])
    z, n, zb, nb = {}, {}, 0.0, 0.0
    prior = (labels.sum() + 1) / (len(labels) + 10)
    base = np.log(prior / (1 - prior))
    owner, value = toxicity.features(texts)
    own = [value[owner == i].tolist() for i in range(len(texts))]

    def weight(f):
        return 0.0 if abs(z.get(f, 0.0)) <= toxicity.L1 else -(z[f] - np.sign(z[f]) * toxicity.L1) / ((toxicity.BETA + n[f] ** 0.5) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.EPOCHS):
        for mine, y in zip(own, labels):
            w = {f: weight(f) for f in mine}
            wb = -zb / ((toxicity.BETA + nb**0.5) / toxicity.ALPHA)
            g = 1 / (1 + np.exp(-(sum(w.values()) + wb + base))) - y
            for f in mine:
                old = n.get(f, 0.0)
                z[f] = z.get(f, 0.0) + g - ((old + g * g) ** 0.5 - old**0.5) / toxicity.ALPHA * w[f]
                n[f] = old + g * g
            zb, nb = zb + g - ((nb + g * g) ** 0.5 - nb**0.5) / toxicity.ALPHA * wb, nb + g * g
    want = {f: weight(f) for f in z if weight(f)}
    known, weights, bias = toxicity.fit(texts, labels)
    assert set(known.tolist()) == set(want) and want
    np.testing.assert_allclose(weights, [want[f] for f in known.tolist()], rtol=1e-9)
    assert bias == pytest.approx(base - zb / ((toxicity.BETA + nb**0.5) / toxicity.ALPHA))
