"""What earlier rounds cut short: each case here was lost once."""

import random

import numpy as np
import pytest

from exprspark.llm import decontam, licenses, neardup


def prose(seed: object, n: int) -> str:
    rng = random.Random(str(seed))
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(4, 8))) for _ in range(n))


def shingles(text: str) -> set:
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def alike(a: str, b: str) -> bool:
    x, y = shingles(a), shingles(b)
    return 100 * len(x & y) >= 75 * len(x | y)


def bridged(case: int, size: int = 60) -> tuple[list[str], list[str]]:
    """Two groups of near copies, each alike inside; of the pairs across only the last of each are alike."""
    base, sides = prose(("base", case), 300), [prose(("side", case, k), 44) for k in range(2)]
    left, right = ([f"{base} {side} {prose((case, side, i), 4 if i == size - 1 else 7)}" for i in range(size)] for side in sides)
    return left, right


def test_groups_joined_by_one_pair_are_one_component(spark):
    cases = [bridged(case) for case in range(6)]
    left, right = cases[0]
    assert [(i, j) for i, a in enumerate(left) for j, b in enumerate(right) if alike(a, b)] == [(59, 59)] and alike(left[0], left[1])
    texts = [(1000 * case + i, text) for case, (a, b) in enumerate(cases) for i, text in enumerate(a + b)]
    got = neardup.near_duplicates(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(i, i // 1000 * 1000) for i, _ in texts}


def test_notices_inside_longer_lines_and_across_lines_are_headers(spark):
    notice = "Licensed under the Apache License, Version 2.0."
    texts = [f"Foo Bar Baz. {notice}", f"Copyright 2020 Foo Bar. {notice}", f"{prose('before', 40)} {notice} {prose('after', 40)}", f"{prose('x', 9)} Licensed under the\nApache License,\nVersion 2.0. {prose('y', 9)}",
             f"{prose('p', 30)} the version under {prose('q', 30)}"]
    files = [(f"a/{i}.txt", t) for i, t in enumerate(texts)] + [(f"b/{i}.txt", prose(("file", i), 20)) for i in range(60)]
    got = {r.path: (r.license, r.origin, r.score) for r in licenses.scan(spark.createDataFrame(files, "path string, text string")).where("path like 'a/%'").collect()}
    assert got == {f"a/{i}.txt": ("Apache-2.0", "header", 1.0) for i in range(4)} | {"a/4.txt": (None, None, None)}


def test_a_common_word_outside_the_templates_weighs_little(spark):
    files = [("a/x.txt", "see Licensed under see the Apache License, see Version 2.0.")] + [(f"b/{i}.txt", f"see {prose(('file', i), 20)}") for i in range(60)]
    frame = spark.createDataFrame(files, "path string, text string")
    held = {r.term: r.df for r in licenses.frequencies(frame).collect()}
    assert held["see"] == 61 and held["apache"] == 1
    assert [r.score > 0.9 for r in licenses.scan(frame).where("path = 'a/x.txt'").collect()] == [True]


def leaked(spark, texts: list[str], item: str) -> set[int]:
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return {r.doc_id for r in decontam.leaks(frame, spark.createDataFrame([(1, item)], "item_id bigint, text string")).collect()}


def test_renamed_items_are_found_at_every_offset(spark):
    item = "Anna sold 48 clips to her friends. Anna gave 12 more to a teacher. Anna kept the rest of the box."
    copy = "Boris sold 31 clips to her friends. Boris gave 17 more to a teacher. Boris kept the rest of the box."
    texts = [f"{prose('before', k)} {copy} {prose('after', 9)}" for k in range(6)]
    assert leaked(spark, [*texts, prose("other", 60)], item) == set(range(6))


def test_short_common_runs_are_found_at_every_offset(spark):
    item = "we take one bag of seven apples then they walk home by night and eat two of them with bread"
    copy = item.replace("apples", "pears").replace("night", "noon")
    assert leaked(spark, [f"{prose('b', k)} {copy}" for k in range(6)], item) == set(range(6))


def test_items_dense_in_numbers_are_found(spark):
    item = "x = 3 + 4 and y = 5 - 2 so z = 7 + 3"
    assert leaked(spark, [f"{prose('b', k)} x = 13 + 14 and y = 15 - 12 so z = 17 + 13 {prose('c', 4)}" for k in range(6)], item) == set(range(6))


def test_copies_with_an_inserted_word_or_one_odd_slot_are_found(spark):
    item = "the baker sells 5 loaves every morning and the miller brings 7 sacks of flour and then both count 5 coins on the table"
    texts = [item.replace("brings 7", "brings of course 7"), item.replace("brings 7 sacks", "brings sacks"), item.replace("count 5", "count 6"), item[: len(item) // 2]]
    assert leaked(spark, texts, item) == {0, 1, 2}


UNRELATED = {
    "de": ("Der Hund lief zum Haus und die Katze sah den Vogel im Garten neben dem Baum.", "Der Bote lief zum Dorf und die Frau sah den Mann im Laden neben dem Platz."),
    "en": ("Last week Anna ran to Paris and Clara saw Boris in London with Karl near Berlin.", "Last week Doris ran to Madrid and Emma saw Diego in Lisbon with Paul near Naples."),
    "fr": ("Le soir Paul voit Marie avec Jean dans la rue et Luc avec Anne dans le parc de Lyon.", "Un jour Marc perd Julie avec Hugo dans la neige et Remi avec Lena dans le port de Nice."),
    "es": ("Ayer Pablo vio a Maria con Juan en la calle y a Lucas con Elena en el parque de Madrid.", "Luego Diego dio a Sofia con Mateo en la noche y a Bruno con Laura en el puerto de Burgos."),
}


@pytest.mark.parametrize("lang", sorted(UNRELATED))
def test_sentences_that_share_little_but_small_words_are_no_leaks(spark, lang):
    item, other = UNRELATED[lang]
    assert leaked(spark, [f"{prose('a', 5)}. {item} {prose('b', 5)}", f"{prose('c', 5)}. {other} {prose('d', 5)}"], item) == {0}


def test_german_items_with_other_numbers_are_leaks(spark):
    item = "Der Bauer kauft 12 Kisten mit je 30 Eiern und verliert davon 4 Stunden lang 7 Eier auf dem Weg zum Markt."
    copy = item.replace("12", "15").replace("30", "24").replace("4 ", "6 ").replace("7 ", "9 ")
    assert leaked(spark, [copy, copy.lower(), prose("x", 40)], item) >= {0}


def test_texts_with_one_long_passage_in_common_are_not_paired_one_by_one(spark, monkeypatch):
    """160 texts at similarity about 0.6 and three at 0.75 or more to one of them: what is compared pair by pair stays few."""
    rng = random.Random(11)
    shared = [f"s{k}" for k in range(60)]
    own = [[f"o{i}x{k}" for k in range(17)] for i in range(160)]
    texts = [(i, " ".join(shared + words)) for i, words in enumerate(own)]
    texts += [(1000 + i, " ".join(shared + own[i][:-1] + [f"z{rng.random()}"])) for i in range(3)]
    monkeypatch.setattr(neardup, "SMALL_BUCKET", 4)
    seen, links = [], neardup._links
    monkeypatch.setattr(neardup, "_links", lambda pairs, rows: seen.append(pairs.count()) or links(pairs, rows))
    got = neardup.near_duplicates(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(i, i) for i in range(160)} | {(1000 + i, i) for i in range(3)}
    assert sum(seen) < 20 * len(texts)


def test_products_of_blocks_count_what_sets_share(monkeypatch):
    monkeypatch.setattr(neardup, "VALUES", 7)
    rng = np.random.default_rng(2)
    one, two = ([np.unique(rng.integers(0, 90, rng.integers(1, 60))).astype(np.uint64) for _ in range(k)] for k in (9, 14))
    got = neardup.intersections(one, two)
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in two] for a in one]
    linked = got > 25
    i, j = neardup.spanning(linked)
    assert linked[i, j].all() and len(i) < 9 + 14

    def roots(pairs):
        at = list(range(23))
        for _ in range(23):
            for a, b in pairs:
                at[a] = at[9 + b] = min(at[a], at[9 + b])
        return at

    assert roots(zip(i, j)) == roots(zip(*np.nonzero(linked)))
