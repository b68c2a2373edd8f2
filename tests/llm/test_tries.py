import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tesselark.llm import tries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
KIND = "conv_id long, turn long, role string, text string"


def label(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()


def brute(rows, every=20):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append((turn is not None, turn or 0, label(role, text), (role, text)))
    own = {c: [t[-1] for t in sorted(ts)] for c, ts in own.items()}
    made = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = own.get(c - int(np.fmod(c, every)), [])[:h] + ts[h:]
    members = {}
    for c, ts in made.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
    out = []
    for node, ids in members.items():
        below = [m for m in members if m[: len(node)] == node]
        children = [m for m in below if len(m) == len(node) + 1]
        leaves = sum(not any(len(x) == len(m) + 1 and x[:-1] == m for x in below) for m in below)
        saved = sum((len(members[m]) - 1) * len(WORD.findall(m[-1][1])) for m in below if m)
        ends = ",".join(map(str, sorted(c for c in ids if len(made[c]) == len(node))))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(ids), len(node), parent, len(ids), len(children), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def made_rows(n, seed, turns=6):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.randint(1, turns)):
            common = rng.random() < 0.6
            rows.append((c, t, rng.choice(("user", "assistant", None)) if not common else "user", " ".join(rng.choices("abc", k=rng.choice((0, 1, 2)))) if not common else f"the turn {t}"))
    return rows


def compare(spark, rows, **more):
    got = tries.prefix_trie(spark.createDataFrame(rows, KIND).repartition(3), **more).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


@pytest.mark.parametrize("nodes", [12, 60, 100_000])
def test_same_nodes_as_plain_tries(spark, monkeypatch, nodes):
    monkeypatch.setattr(tries, "ID_BITS", 3)
    compare(spark, made_rows(110, 7), nodes=nodes)


def test_one_common_conversation_and_one_common_first_turn(spark):
    rows = [(c, t, "user", f"same {t}") for c in range(0, 60) for t in range(7)]
    rows += [(c, t, "user", "same 0" if t == 0 else f"{c} {t}") for c in range(60, 90) for t in range(5)]
    compare(spark, rows, nodes=20)


def test_ties_nulls_repeats_negative_ids_and_turnless_conversations(spark):
    rows = [(c, None if t == 1 else t, None if t == 2 else "u", None if c % 3 == 0 else f"text {t} \t\n{t}") for c in (-45, -40, -3, 0, 1, 2, 19, 20, 25, 41, 43, 10**12) for t in range(c % 4 + 1)]
    rows += [(5, 0, "a", "x"), (5, 0, "b", "y"), (5, 0, "b", "y"), (None, 0, "u", "left out"), (7, 0, "", ""), (8, 0, None, None), (9, 0, "u", "w " * 40_000)]
    compare(spark, rows, nodes=15)


def test_empty_tables_and_other_columns(spark):
    assert tries.prefix_trie(spark.createDataFrame([], KIND)).count() == 0
    rows = made_rows(30, 2)
    frame = spark.createDataFrame([(*r, b"k", 1, "s") for r in rows], KIND + ", key binary, n int, seq string")
    assert sorted(map(tuple, tries.prefix_trie(frame).collect()), key=str) == brute(rows)


def test_louds_bits_give_each_parent():
    rng = random.Random(4)
    rows = sorted({tuple(rng.choices(range(3), k=rng.randint(0, 6))) for _ in range(80)})
    flat = np.array([[x, x] for r in rows for x in r], np.uint64).reshape(-1, 2)
    trie = tries.Louds(flat, np.concatenate([[0], np.cumsum([len(r) for r in rows])]))
    level = sorted({r[:d] for r in rows for d in range(len(r) + 1)}, key=lambda p: (len(p), p))
    assert trie.parents().tolist() == [level.index(p[:-1]) if p else -1 for p in level]
    assert [int(flat[k, 0]) for k in trie.label[1:]] == [p[-1] for p in level[1:]]
    assert trie.bits.sum() == len(level) and len(trie.bits) == 2 * len(level) + 1
    for i, r in enumerate(rows):
        for d in range(len(r) + 1):
            assert level[int(trie.node(np.array([i]), np.array([d]))[0])] == r[:d]


def test_conversations_longer_than_a_shard(spark):
    rows = [(c, t, "u", f"{t}" if t < 150 else f"{c % 5} {t}") for c in range(24) for t in range(0, 200, 1 + c % 3)]
    compare(spark, rows, nodes=50)
