from __future__ import annotations

import random

from tidemark.llm.contamination import gram_width, leaked_items, longest_passage, plain_words, without_leaks

WORDS = [f"word{k}" for k in range(400)]


def text_of(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def test_plain_words():
    assert plain_words("**Kernel.go**, <b>at​</b>&lt;i&gt;ＷＩＤＥ&lt;/i&gt;\nсat") == ["kernelgo", "at", "wide", "cat"]
    assert plain_words("") == plain_words(None) == plain_words(" -- \n") == []


def test_bound_on_hits_is_exact():
    rng = random.Random(8)
    for length in (1, 2, 3, 6, 7, 9, 12, 16, 18, 24, 47, 80, 121):
        width, fewest = gram_width(length, 5, 0.5, 8)
        assert fewest >= 1
        for k in range(-(-length // 2), length + 1):
            for _ in range(40):
                altered = set(rng.sample(range(k), k // 8))
                intact = sum(not altered & set(range(s, s + width)) for s in range(k - width + 1))
                assert intact >= fewest


def test_short_items_with_an_altered_word(spark):
    rng = random.Random(21)
    items = {n: [f"i{n}w{k}" for k in range(n)] for n in range(6, 19)}
    docs = {}
    for n, words in items.items():
        part = words[: -(-n // 2)]
        if len(part) >= 8:
            part = [*part[:4], "altered", *part[5:]]
        docs[n] = " ".join([text_of(rng, 30), *part, text_of(rng, 30)])
        docs[100 + n] = " ".join([text_of(rng, 30), *words[: n // 2 - 1], text_of(rng, 30)])
    d = spark.createDataFrame([*docs.items()], "doc_id long, text string")
    e = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in leaked_items(d, e).collect()}
    assert {(n, n) for n in items} <= found
    assert all(a == b or a - 100 == b for a, b in found)


def test_longest_passage():
    item = [f"w{k}" for k in range(40)]
    assert longest_passage(item, ["x", *item[5:30], "y"]) == (25, 1, 25)
    assert longest_passage(item, ["x"]) == (0, 0, 0)


def test_leaks(spark):
    rng = random.Random(11)
    items = {k: text_of(rng, 60) for k in range(6)}
    half = items[1].split()[10:45]
    half[3], half[15], half[28] = "changed", "altered", "other"
    docs = {
        1: "intro " + items[0] + " outro",
        2: " ".join(half).upper().replace(" ", "\n"),
        3: " ".join(items[2].split()[:18]) + text_of(rng, 50),
        4: text_of(rng, 300),
        5: " ".join(sorted(items[3].split())),
        6: text_of(rng, 5000) + " " + items[4] + " " + text_of(rng, 5000) + " " + items[5],
        7: "",
        8: None,
    }
    d = spark.createDataFrame([(k, v, 1) for k, v in docs.items()] + [(1, docs[1], 1), (None, items[0], 1)], "doc_id long, text string, item_id int")
    e = spark.createDataFrame([*items.items(), (0, items[0]), (90, ""), (91, None), (92, "rare words only"), (None, "x")], "item_id long, text string")
    want = {(1, 0), (2, 1), (6, 4), (6, 5)}
    found = leaked_items(d, e)
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == want
    assert {(r["doc_id"], r["item_id"]) for r in leaked_items(d, e, block_items=2).collect()} == want
    clean = {r["doc_id"] for r in without_leaks(d, found).collect()}
    assert clean == {3, 4, 5, 7, 8, None}
    assert leaked_items(d.where("false"), e).count() == leaked_items(d, e.where("false")).count() == 0


def test_spans_and_short_items(spark):
    d = spark.createDataFrame([(1, "a b Three words here c d")], "doc_id long, text string")
    e = spark.createDataFrame([(7, "three words here")], "item_id long, text string")
    r = leaked_items(d, e).collect()[0]
    assert (r["first_word"], r["last_word"], r["share"]) == (2, 4, 1.0)
