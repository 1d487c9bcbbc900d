"""Packed pieces put back together, and the limits of every sequence."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from exprspark.llm import packing, queries


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(packing.VOCABULARY)


def sequences(rows):
    out = defaultdict(list)
    for r in rows:
        out[r.sequence_id].append(r)
    for own in out.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
        assert [r.segment for r in own] == list(range(len(own)))
    return out


ODD = ["", " \n ", "DON'T we'll x's 12345 …!? <|endoftext|>abc <|ENDOFTEXT|>", "á ́b É é\tΟΔΟΣ İ \x1c q\x1dr \x00 a\x85b　c ,̈ \n̈k Mr.. a,b. c-,d.'", "word " * 9000, "x" * 9000]


def test_ids_equal_the_tokenizers(tokenizer):
    rng = random.Random(4)
    texts = ODD + ["".join(rng.choice("aB é.,'!?\n\t0ñ<|-ßİ̈\u0958ΣσK日ªж") for _ in range(60)) for _ in range(300)]
    words = packing.Words(tokenizer.to_str())
    for part in (texts[:50], texts[50:], texts):  # the last time from memory
        assert [np.frombuffer(x, "<u4").tolist() for x in words([t.encode() for t in part])] == [e.ids for e in tokenizer.encode_batch(part, add_special_tokens=False)]


def test_documents_round_trip(spark, tokenizer):
    rng = random.Random(5)
    texts = ODD + [None, None] + [" ".join("".join(rng.choice("abcde") for _ in range(5)) for _ in range(rng.choice([3, 60, 700, 3000]))) for _ in range(80)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(9, texts[9]), (9, texts[9])]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 as ids", "2 as sequence_id").repartition(3)
    rows = packing.pack(packing.encode(frame)).collect()
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
    for i, text in enumerate(texts):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        own = sorted(pieces[i], key=lambda r: r.start)
        times = 3 if i == 9 else 1
        assert sorted(p for r in own for p in range(r.start, r.start + r.length)) == sorted(list(range(len(ids))) * times)
        assert all(np.frombuffer(r.ids, "<u4").tolist() == ids[r.start : r.start + r.length] and r.doc_tokens == len(ids) for r in own)
    found = sequences(rows)
    assert all(sum(r.length for r in own) <= 4096 for own in found.values())
    lengths = [sum(r.length for r in own) for own in found.values()]
    assert sum(4096 - n for n in lengths if n & (n - 1)) == 0


def test_query_digests(spark, tokenizer):
    base = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{base}/documents.parquet").collect()}
    rows = queries.QUERIES["op13_vector_packing"](spark, base).collect()
    assert {r.doc_id for r in rows} == set(texts)
    total = 0
    for r in rows:
        ids = np.array(tokenizer.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [2], "<u4")
        assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids)
        total += r.length
    assert total == sum({r.doc_id: r.doc_tokens for r in rows}.values())
    sequences(rows)


@pytest.mark.parametrize("limits", [packing.Limits(64, 3, 20), packing.Limits(64, 100, 64), packing.Limits(50, 2, 1), packing.Limits(1, 1, 1)])
def test_all_limits_hold(spark, limits):
    rng = random.Random(limits.loss)
    examples = [(i, np.arange(n, dtype="<u4").tobytes(), rng.choice([None, 0, n // 2, n])) for i, n in enumerate(rng.choice([1, 5, 30, 64, 200]) for _ in range(150))]
    examples += [(500, b"", 0), (501, None, 0), (None, b"\0\0\0\0", 5)]
    rows = packing.pack(spark.createDataFrame(examples, "doc_id bigint, ids binary, loss_from bigint").coalesce(1), limits).collect()
    place = {i: (np.frombuffer(x or b"", "<u4"), f) for i, x, f in examples}
    assert sum(r.length for r in rows) == sum(len(x) for x, _ in place.values())
    for r in rows:
        ids, loss_from = place[r.doc_id]
        assert r.loss == sum(loss_from is not None and p >= loss_from for p in range(r.start, r.start + r.length))
        assert np.frombuffer(r.ids, "<u4").tolist() == ids[r.start : r.start + r.length].tolist()
    for own in sequences(rows).values():
        assert sum(r.length for r in own) <= limits.tokens and len(own) <= limits.segments and sum(r.loss for r in own) <= limits.loss


def test_scarce_room_decides():
    """Long prompts with short answers pair with short prompts with long answers."""
    packer = packing.Packer(packing.Limits(100, 2, 60))
    for k in range(40):
        packer.add(k, 50, 40 if k % 2 else 0)  # 10 or 50 loss-bearing tokens of 50
    packer.weigh()
    made = []
    while packer.size:
        made.append(packer.fill())
    assert len(made) == 20 and all({name % 2 for name, _, _ in own} == {0, 1} for own in made)


def test_empty_table(spark):
    assert packing.pack(packing.encode(spark.createDataFrame([], "doc_id bigint, text string"))).count() == 0
