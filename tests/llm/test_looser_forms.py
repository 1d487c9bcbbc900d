"""Personal data beyond the base rules: found by the trained model in texts it has not seen, plain numbers left alone."""

import random

from exprspark.llm import pii

WORDS = "river stone window letter garden paper bridge morning quiet number light answer market winter table story".split()


def prose(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


def test_looser_forms_are_added_and_plain_numbers_are_not(spark):
    r = random.Random(5)
    texts = [f"{prose(r, 20)} +49 30 {r.randrange(10**6, 10**7)} {prose(r, 5)} a{i}@host.org {prose(r, 20)}" for i in range(900)]
    model = pii.train(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string"))
    total, found, wrong, plain = {}, {}, 0, 0
    for _ in range(1500):
        lead, form, kind = pii.planted(r)
        before = prose(r, 8) + " " + lead
        text = f"{before}{form} {prose(r, 8)}"
        base, spans = pii.select(text, model)
        if any(s < len(before) + len(form) and len(before) < e for _, s, e in base):
            continue
        added = [s for s in spans if s not in base]
        if kind is None:
            plain += 1
            wrong += bool(added)
        else:
            total[kind] = total.get(kind, 0) + 1
            found[kind] = found.get(kind, 0) + (added == [(kind, len(before), len(before) + len(form))])
    print(model.thresholds, total, found, wrong, plain)
    assert all(found[k] >= 0.9 * total[k] for k in ("email", "card", "phone"))
    assert plain > 300 and wrong <= 0.02 * plain
    for text, kind in (("please call me at tel (555) 555-0100 today", "phone"), ("our phone: 030 1234 5678 is free", "phone"), ("visa 4111 1111 1111 116 expires", "card"),
                       ("write to ann.b (at) mail (dot) org today", "email")):
        base, spans = pii.select(text, model)
        assert not base and [s[0] for s in spans] == [kind], (text, spans)
    for text in ("the order 20210304 was sent", "from 2001-2005 in total 1234567 people", "version 1.2.300.4 of page 1234 5678"):
        assert pii.select(text, model) == ([], []), text


def test_training_reads_every_document(spark):
    """Base rate, trees and margins are those of all candidates left in the fit, not of a first part of them."""
    import hashlib

    import numpy as np

    r = random.Random(6)
    texts = [f"{prose(r, 6)} +49 30 {r.randrange(10**6, 10**7)} {prose(r, 6)} {r.randrange(10**8)} {prose(r, 4)}" for _ in range(3500)]
    model = pii.train(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3))
    rows = []
    for text in texts:
        for _, x, y, _ in pii.examples(text):
            digest = hashlib.blake2b(np.array([*map(float, x), len(text)]).tobytes(), digest_size=8).digest()
            if int.from_bytes(digest, "little", signed=True) % 4:
                rows.append((x, y))
    x, y = np.array([x for x, _ in rows], dtype=float), np.array([y for _, y in rows], dtype=float)
    assert len(y) > 15_000  # three quarters of 20,000
    share = (y.sum() + 1) / (len(y) + 2)
    assert abs(model.base - np.log(share / (1 - share))) < 1e-12
    assert np.abs(model.margin(x) - pii.fit(x, y).margin(x)).max() < 1e-6
