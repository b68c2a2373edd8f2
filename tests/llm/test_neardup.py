import random
import re

from tesselark.llm import neardup


def brute(rows, words, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        grams = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
        sets.setdefault(i, []).append(grams)
    ids = list(sets)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                ra, rb = sorted((find(a), find(b)))
                root[rb] = ra
    return {i: find(i) for i in ids}, {i: len(s[0]) for i, s in sets.items()}


def made_rows():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(4000)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows, n = [], 0

    def add(words):
        nonlocal n
        rows.append((n, " ".join(words)))
        n += 1

    for g in range(12):  # near copies, from close to just beyond the threshold
        base = [rng.choice(vocabulary) for _ in range(rng.randint(20, 400))]
        for c in range(rng.randint(2, 14)):
            copy = list(base)
            for _ in range(int(len(base) * rng.choice((0, 0.01, 0.02, 0.03, 0.05)))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            add(copy)
    for _ in range(60):  # different texts that share a passage
        add([rng.choice(vocabulary) for _ in range(rng.randint(5, 120))] + passage)
    for t in ("", " \n\t", "one", "One", "one two", "a b c", "A B c", "a b c d", "a b c d", "é è"):
        rows.append((n, t))
        n += 1
    rows.append((n, None))
    return rows


def test_classes_match_all_pairs(spark):
    rows = made_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for words in (4, 5):
        got = {r.doc_id: r for r in neardup.near_duplicates(docs, words=words).collect()}
        want, sizes = brute(rows, words, 80)
        assert {i: r.component_id for i, r in got.items()} == want
        assert {i: r.n_shingles for i, r in got.items()} == sizes
        assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_large_group_of_near_copies_needs_no_pairs(spark):
    rng = random.Random(5)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(300):
        copy = list(base)
        for _ in range(rng.choice((1, 2, 4, 6, 8))):
            copy[rng.randrange(150)] = f"x{rng.random()}"
        rows.append((i, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, words=4).collect()}
    assert got == brute(rows, 4, 80)[0]


def test_nulls_repeats_empty_tables_and_clashing_names(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    t = "the same text in several rows of the table"
    rows = [(None, t, "n"), (7, t, "a"), (7, t, "b"), (3, t, None), (9, None, "c"), (None, None, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = sorted(((r.doc_id if r.doc_id is not None else -1, r.component_id, r.kept) for r in neardup.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(-1, None, True), (-1, None, True), (3, 3, True), (7, 3, False), (7, 3, False), (9, 9, True)], key=str)


def test_pigeonhole_buckets_hold_every_pair_within_the_distance():
    import numpy as np

    rng = np.random.default_rng(0)
    most = neardup.CHUNKS * (neardup.ERRORS + 1) - 1
    for _ in range(50):
        a = rng.integers(0, 256, neardup.VALUES).astype(np.uint8)
        b = a.copy()
        at = rng.choice(neardup.VALUES, most, replace=False)
        b[at] += 1
        keys = neardup.bucket_keys(np.stack([a, b]))
        assert set(keys[0]) & set(keys[1])


def test_groups_of_several_blocks_that_are_not_one_component(spark):
    rng = random.Random(8)
    base = [f"b{i}" for i in range(80)]
    rows = []
    for i in range(160):  # copies that are near their neighbours, far from most others
        copy = list(base)
        for _ in range(rng.choice((1, 5, 9, 14, 18))):
            copy[rng.randrange(80)] = f"x{rng.random()}"
        rows.append((i, " ".join(copy + [f"t{k}" for k in range(rng.choice((0, 0, 0, 10, 30)))])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, words=2, block_shingles=500).collect()}
    want = brute(rows, 2, 80)[0]
    assert len(set(want.values())) > 5 and got == want


def test_buckets_over_several_batches_have_one_hub():
    import pyarrow as pa

    def rows(keys, ids):
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ids, pa.int64())], ["key", "id"])

    batches = [rows([1, 1, 2], [4, 5, 1]), rows([], []), rows([2, 2, 3], [2, 3, 8]), rows([3], [11]), rows([4], [1])]
    got = [p for b in neardup._hubs(iter(batches)) for p in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert got == [(1, 4, 5), (2, 1, 2), (2, 1, 3), (3, 8, 11)]


def test_every_bucket_has_one_group_over_several_blocks(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(neardup, "TOGETHER", 40)
    rng = np.random.default_rng(2)
    sigs = rng.integers(0, 4, (300, neardup.VALUES)).astype(np.uint8)  # few values, so buckets are shared
    rows = [(bytes([i % 256, i // 256]), i, 1, bytearray(s.tobytes())) for i, s in enumerate(sigs)]
    classes = spark.createDataFrame(rows, "set_key binary, id long, n long, sig binary").repartition(3)
    edges, _ = neardup._candidates(classes, "bigint", neardup.Tables(spark))
    got = {(r.hub, r.id) for r in edges.collect()}
    keys = neardup.bucket_keys(sigs)
    hub = {}
    for i, own in enumerate(keys.tolist()):
        for k in own:
            hub.setdefault(k, i)
    assert got == {(hub[k], i) for i, own in enumerate(keys.tolist()) for k in own if hub[k] != i} and len(got) > 500


def test_pairs_of_template_texts_in_different_blocks_are_linked(spark, monkeypatch):
    monkeypatch.setattr(neardup, "TOGETHER", 256)
    rows, n = [], 1500
    for p in range(n):  # two texts share 90 of 110 words, texts of two pairs 84 of 116
        shared = [f"t{k}" for k in range(84)] + [f"p{p}_{k}" for k in range(6)]
        rows += [(p, " ".join(shared + [f"a{p}_{k}" for k in range(10)])), (n + p, " ".join(shared + [f"b{p}_{k}" for k in range(10)]))]
    rows.append((2 * n, " ".join(f"t{k}" for k in range(84))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6, "doc_id")
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, words=1, block_shingles=30_000).collect()}
    hub = {i: i % n for i, _ in rows} | {2 * n: 2 * n}
    near_template = 100 * 84 >= 80 * 100  # the bare template is linked with every text
    assert got == (dict.fromkeys(hub, 0) if near_template else hub)
    rows.pop()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6, "doc_id")
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, words=1, block_shingles=30_000).collect()}
    assert got == {i: i % n for i, _ in rows}


def test_links_in_a_block_by_differences_from_its_first_set():
    import numpy as np

    rng = np.random.default_rng(6)
    for base in (0, 5, 40):
        for _ in range(60):
            core = rng.choice(60, base, replace=False)
            sets = [np.unique(np.concatenate([rng.permutation(core)[: max(1, base - rng.integers(0, 9))], rng.integers(60, 90, rng.integers(1, 9))])).astype(np.uint64) for _ in range(25)]
            if base == 40:
                sets[0] = core.astype(np.uint64)
                sets[0].sort()
            links = list(neardup._meet(sets, 80, np.arange(25), np.arange(1, 25)))
            near = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b))
            assert all(near(sets[a], sets[b]) for a, b in links)
            roots = []
            for pairs in (links, [(a, b) for a in range(25) for b in range(a) if near(sets[a], sets[b])]):
                root = list(range(25))
                for _ in range(25):
                    for a, b in pairs:
                        root[a] = root[b] = min(root[a], root[b])
                roots.append(root)
            assert roots[0] == roots[1]


def test_span_hashes_of_texts_longer_than_a_step(monkeypatch):
    import numpy as np

    from tesselark.llm import text as tx

    data = np.frombuffer(bytes(random.Random(1).choices(b"ab c", k=5000)), np.uint8).copy()
    data[1000:2500] = 97  # a word longer than a step
    starts, stops, _ = tx.words_of(data, np.array([0, 5000]))
    whole = tx.span_hashes(data, starts, stops)
    monkeypatch.setattr(tx, "STEP_BYTES", 256)
    assert (tx.span_hashes(data, starts, stops) == whole).all()


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = {r.id: r.component for r in neardup.components(links).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}
