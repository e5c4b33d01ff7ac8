"""The trie against one built turn by turn in Python, over many blocks, with copies that fill whole blocks; stated results of odd input."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from panelwright.llm import prefix_trie
from panelwright.llm.prefix_trie import RangeMin, neighbour_lcps

SCHEMA = "conv_id bigint, turn bigint, role string, text string, n_convs string"


def built_by_hand(rows):
    """(depth, parent's depth and smallest member, ...) of every node, from dictionaries of prefixes."""
    turns = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            turns.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(t, key=lambda x: x[:2])] for c, t in turns.items()}
    nodes = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        seq = tuple(turns.get(base, [])[:h] + own[h:])
        for d in range(len(seq) + 1):
            node = nodes.setdefault(seq[:d], {"members": [], "ends": []})
            node["members"].append(c)
            if d == len(seq):
                node["ends"].append(c)
    out = []
    for seq, node in nodes.items():
        below = [s for s in nodes if s[: len(seq)] == seq]
        leaves = [s for s in below if not any(len(o) > len(s) and o[: len(s)] == s for o in below)]
        saved = sum((len(nodes[s]["members"]) - 1) * len(s[-1][1].encode()) for s in below if s)
        kids = [s for s in below if len(s) == len(seq) + 1]
        parent = min(nodes[seq[:-1]]["members"]) if seq else None
        digest = hashlib.sha256(",".join(map(str, sorted(node["ends"]))).encode()).hexdigest()
        out.append((min(node["members"]), len(seq), parent, len(node["members"]), len(kids), len(leaves), saved, digest))
    return sorted(out, key=str)


def found(spark, rows, **bounds):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    got = prefix_trie.prefix_trie(df, **bounds).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted((tuple(r) for r in got.collect()), key=str)


def random_rows(seed, convs, words):
    draw = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(draw.choice([0, 1, 2, 3, 5, 9])):
            rows.append((c, t, draw.choice(["user", None]), draw.choice(words)))
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("block_turns", [3, 17, 100_000])
def test_against_prefix_dictionaries(spark, many_pieces, block_turns):
    rows = random_rows(block_turns, 120, ["a", "b", None, "", "é ñ"])
    assert found(spark, rows, block_turns=block_turns) == built_by_hand(rows)


def test_copies_over_many_blocks(spark, many_pieces):
    """A third of all conversations are one and the same, others go on from it."""
    rows = [(c, t, "user", f"common {t}") for c in range(200) for t in range(3)]
    rows += [(c, t, "user", f"common {t}" if t < 3 else f"own {c} {t}") for c in range(200, 300) for t in range(5)]
    rows += random_rows(1, 0, ["x"]) + [(c, 0, "user", f"alone {c}") for c in range(300, 500)]
    assert found(spark, rows, block_turns=40) == built_by_hand(rows)


def test_odd_input(spark):
    rows = [
        (1, None, "user", "first"),
        (1, 3, None, None),
        (1, 3, None, None),
        (-3, 0, "user", "below zero"),
        (0, 0, "user", "x" * 300_000),
        (0, 1, "user", ""),
        (None, 0, "user", "nowhere"),
        (7, 0, "user", "role"),
        (8, 0, "use", "rrole"),
    ]
    assert found(spark, rows) == built_by_hand(rows)
    assert found(spark, rows[6:7]) == [] and found(spark, []) == []


def test_turnless_after_rebuilding(spark):
    """Conversations that take over more turns than the first of their family has, and have no later ones, are members of the root alone."""
    lone = [c for c in range(1, 400) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 1]
    rows = [(c, 0, "user", "gone") for c in lone if c - c % 5 not in lone]
    got = found(spark, rows, block_turns=10)
    assert got == built_by_hand(rows)
    assert [r[1] for r in got] == [0] and got[0][5] == 1


def test_range_minima():
    draw = np.random.default_rng(5)
    values = draw.integers(0, 4, 50)
    table = RangeMin(values)
    a, b = np.meshgrid(np.arange(50), np.arange(50))
    a, b = a[a <= b], b[a <= b]
    assert table.over(a, b).tolist() == [values[x : y + 1].min() for x, y in zip(a, b)]
    floor = draw.integers(0, 5, 51)
    places = np.arange(51)
    right = [next((n for n, v in enumerate(values[x:]) if v < f), 50 - x) for x, f in zip(places, floor)]
    left = [next((n for n, v in enumerate(values[:x][::-1]) if v < f), x) for x, f in zip(places, floor)]
    assert table.reach_right(places, floor).tolist() == right
    assert table.reach_left(places, floor).tolist() == left


def test_neighbour_lcps():
    seqs = [[], [1], [1], [1, 2], [1, 2, 3], [1, 3], [4, 4, 4]]
    symbols = np.array([[x, x] for s in seqs for x in s], np.uint64)
    assert neighbour_lcps(symbols, np.array([len(s) for s in seqs])).tolist() == [-1, 0, 1, 1, 2, 1, 0]
