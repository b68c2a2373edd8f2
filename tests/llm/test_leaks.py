import hashlib
import random
import re

import pytest

from tesselark.llm import leaks

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, window=10):
    words, hit, named = words_of(text), set(), set()
    for item, body in items:
        own = words_of(body)
        n = min(window, len(own))
        if not n or item is None:
            continue
        windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)}
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in windows:
                hit.update(range(i, i + n))
                named.add(str(item))
    return len(words), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)


def compare(spark, docs, items, **more):
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = leaks.contamination(frame, spark.createDataFrame(items, "item_id long, text string"), **more).collect()
    want = [(i, *brute(t, items)) for i, t in docs]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    return got


def test_every_shared_window_is_found(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "ß9", "İ"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice((1, 2, 4, 5, 6, 9, 10, 11, 30))))) for i in range(40)]
    items += [(100, items[-1][1]), (100, "another text of item 100 with more than ten words in it"), (7, items[3][1].upper())]
    docs = []
    for d in range(120):
        text = rng.choices(vocabulary, k=rng.randint(0, 80))
        for _ in range(rng.randint(0, 3)):
            own = rng.choice(items)[1].split()
            a = rng.randrange(len(own))
            text[rng.randint(0, len(text)) : 0] = own[a : a + rng.choice((9, 10, 12, 40))]
        docs.append((d, rng.choice((" ", ", ", "\n")).join(text)))
    got = compare(spark, docs, items)
    assert 20 < sum(r.contaminated for r in got)


def test_no_items_no_documents_nulls_repeats_and_long_texts(spark):
    line = "one two three four five six seven eight nine ten eleven"
    docs = [(None, line), (1, line), (1, line), (2, None), (3, ""), (4, "?!"), (5, line.rsplit(" ", 2)[0])]
    docs += [(6, "x " * 30_000 + line + " y" * 30_000), (7, "same " * 5000)]
    items = [(1, line), (None, line), (2, None), (3, " .. "), (4, "same " * 30), (5, line)]
    compare(spark, docs, items)
    empty = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame(docs, "doc_id long, text string")
    assert not any(r.contaminated for r in leaks.contamination(some, empty).collect())
    assert leaks.contamination(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_clashing_names(spark):
    names = "doc_id string, text string, key int, owner string, start int, windows string, item string"
    line = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([("a", line, 1, "o", 2, "w", "i")], names)
    items = spark.createDataFrame([("q", line, 1)], "item_id string, text string, size int")
    assert tuple(leaks.contamination(docs, items).first())[:4] == ("a", 11, 11, 1)


def test_a_filter_that_lets_all_pass_changes_nothing(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(leaks, "_filter", lambda prints: np.full(1 << (leaks.FILTER_BITS - 6), 2**64 - 1, np.uint64))
    compare(spark, [(1, "a b c d e f g h i j k l m"), (2, "x y")], [(1, "c d e f g h i j k l"), (2, "y z")])


@pytest.mark.parametrize("size", [1, 3, 5, 6, 10])
def test_winnowing_keeps_one_of_each_window(size):
    import numpy as np

    rng = np.random.default_rng(1)
    words = rng.integers(0, 2**63, 200).astype(np.uint64)
    first = np.array([0, 0, 50, 53, 200])
    places, prints, windows = leaks.winnowed(words, first, size)
    gram = min(leaks.GRAM, size)
    for a, b in zip(first[:-1], first[1:], strict=True):
        for i in range(a, b - size + 1):
            assert ((places >= i) & (places + gram <= i + size)).any()
    assert len(places) < 0.75 * 200 or size <= 5
