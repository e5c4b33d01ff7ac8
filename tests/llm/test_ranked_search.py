"""Ranked search against whole scoring in Python, over many blocks and groups, with ties, copies and common words."""

import math
import random
import re

import pytest

from panelwright.llm import ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ranked_by_hand(docs, items, top):
    terms = [(d, TERM.findall((t or "").translate(LOWER))) for d, t in docs]
    terms = [(d, t) for d, t in terms if t]
    n_docs, length = len(terms), sum(len(t) for _, t in terms)
    df = {}
    for _, t in terms:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    out = []
    for item, text in items:
        scores = []
        for d, t in terms:
            m = 75 + (25 * len(t) * n_docs) // length
            score = 0
            for w in TERM.findall((text or "").translate(LOWER)):
                tf = t.count(w)
                if tf:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1000000000 * tf) // (1000 * tf + 12 * m))
            if score:
                scores.append((-score, d is None, d or 0))
        out += [(item, r + 1, None if null else d, -s) for r, (s, null, d) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=str)


def found(spark, docs, items, **options):
    left = spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, text string, score int").repartition(5)
    right = spark.createDataFrame([(*i, 2) for i in items], "item_id bigint, text string, rank int").repartition(3)
    got = ranked_search.rank_documents(left, right, **options).select("item_id", "rank", "doc_id", "score")
    return sorted((tuple(r) for r in got.collect()), key=str)


def corpus(seed, n):
    draw = random.Random(seed)
    words = [f"w{min(int(draw.paretovariate(0.7)), 300)}" for _ in range(600)] + ["The", "OF", "é1", "ñÑ"]
    docs = [(i, " ".join(draw.choice(words) + draw.choice([" ", ", ", "\n-"]) for _ in range(draw.choice([0, 1, 5, 30])))) for i in range(n)]
    docs += [(n + i, "the common copy of one text w7 w9") for i in range(n // 3)]
    items = [(i, " ".join(draw.choice(words) for _ in range(draw.choice([1, 4, 12])))) for i in range(25)]
    return docs, items + [(90, "w7 common copy"), (91, "the the of"), (92, "w1 w1 w2 w300 copy")]


@pytest.mark.parametrize("small", [False, True])
def test_against_whole_scoring(spark, many_pieces, monkeypatch, small):
    if small:  # many blocks and groups, no vocabulary and no list sent to the tasks
        for name, value in (("BLOCK_DOCS", 7), ("GROUP_ITEMS", 4), ("VOCABULARY_BYTES", 0), ("ASKED_ROWS", 0)):
            monkeypatch.setattr(ranked_search, name, value)
    docs, items = corpus(3, 150)
    assert found(spark, docs, items, top=6) == ranked_by_hand(docs, items, 6)


@pytest.mark.parametrize("shares", [(), (0.02, 0.1, 0.3, 0.5, 0.8)])
def test_any_number_of_owners(spark, shares):
    docs, items = corpus(4, 60)
    assert found(spark, docs, items, top=4, owner_shares=shares) == ranked_by_hand(docs, items, 4)


def test_odd_input(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "SLICE_BYTES", 64)  # a long text is read in slices, never through a word
    docs = [(1, None), (2, ""), (3, " .,\n"), (None, "apple pie"), (None, "apple pie"), (4, "apple pie"), (5, "Apple " * 500 + "pie"), (6, "other " + "z" * 500 + " apple"), (7, "unlike")]
    items = [(1, "apple"), (None, "PIE"), (2, None), (3, "?!"), (4, "absent"), (1, "apple")]
    got = found(spark, docs, items)
    assert got == ranked_by_hand(docs, items, 20)
    assert found(spark, [], items) == [] and found(spark, docs, []) == [] and found(spark, docs[:3], items) == []
    assert found(spark, docs, items[2:5]) == []
