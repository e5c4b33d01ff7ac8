"""The pipeline's near-dedup against all pairs of 5-word shingle sets."""

import random

import pytest

from conftest import SMALL
from panelwright.llm import near_copies


def shingles(text, size=5):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def homes(texts):
    """texts: id -> text; the smallest id reachable over pairs of similarity 0.8."""
    sets, home = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}
    near = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8]
    moved = True
    while moved:
        moved = False
        for a, b in near:
            low = min(home[a], home[b])
            moved |= (home[a], home[b]) != (low, low)
            home[a] = home[b] = low
    return home


def edited(words, n):
    words = list(words)
    for _ in range(n):
        words[random.randrange(len(words))] = f"new{random.randrange(10**6)}"
    return words


@pytest.mark.parametrize("few, settled", [(16, 64), (1, 64), (1, 1)])
def test_chains_and_groups_against_all_pairs(spark, monkeypatch, few, settled):
    """Chains of edits, groups around 0.8, a passage that all share, and case or space changes only."""
    random.seed(11)
    monkeypatch.setattr(near_copies, "FEW", few)
    monkeypatch.setattr(near_copies, "SETTLED", settled)
    texts = []
    for n in (12, 60, 200, 400):
        lead = [f"lead{i}" for i in range(n // 3)]
        for _ in range(3):
            base = lead + [f"w{random.randrange(10**6)}" for _ in range(n)]
            chain = base
            for _ in range(8):
                texts += [" ".join(edited(base, n // 50 + random.randint(0, 2))), " ".join(chain)]
                chain = edited(chain, max(1, n // 60))
            texts.append("  ".join(base).upper())
    texts += ["a b c", "A b\nc", "a b", "", " \n", None]
    random.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    want = homes(dict(enumerate(texts)))
    assert {r.doc_id for r in near_copies.keep_one(df).collect()} == set(want.values())


def test_repeated_ids_keep_unlike_texts(spark):
    one, two = (" ".join(f"{x}{i}" for i in range(50)) for x in "uv")
    rows = [(1, one), (1, two), (1, one), (2, two + " more"), (None, one), (None, None)]
    got = near_copies.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert got.columns == ["doc_id", "text"]
    assert sorted(map(str, got.collect())) == sorted(map(str, spark.createDataFrame([(1, one), (1, two), (None, one), (None, None)], "doc_id bigint, text string").collect()))
    assert near_copies.keep_one(got.limit(0)).count() == 0


@pytest.mark.parametrize("folder", [SMALL, SMALL.replace("sf0.001", "sf0.01")])
def test_stage_leaves_no_pair_of_similarity_08(spark, folder):
    import corpus_pipeline

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = homes({r.doc_id: r.text for r in docs.collect()})
    got = {r.doc_id for r in dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, folder).collect()}
    assert got == set(want.values()) and len(got) < len(want)


@pytest.mark.parametrize("few, settled", [(2, 64), (2, 1)])
def test_groups_without_their_base_against_all_pairs(spark, monkeypatch, few, settled):
    """Members of 0.6 to 0.9 to a base that is not there, clusters of edits of members, and case changes only: differences from a leader find every link."""
    random.seed(21)
    monkeypatch.setattr(near_copies, "FEW", few)
    monkeypatch.setattr(near_copies, "SETTLED", settled)
    base, texts = [f"b{i}" for i in range(150)], []
    for n in range(160):
        member = edited(base, random.randint(1, 6))
        texts.append(" ".join(member))
        if n % 8 == 0:
            texts += [" ".join(edited(member, random.randint(0, 3))) for _ in range(6)] + [" ".join(member).upper()]
        if n % 10 == 0:
            texts.append(" ".join(member[: random.randint(110, 150)] + [f"t{n}x{i}" for i in range(random.randint(0, 20))]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    want = homes(dict(enumerate(texts)))
    assert {r.doc_id for r in near_copies.keep_one(df).collect()} == set(want.values()) and len(set(want.values())) > 10


def test_edits_apart_from_each_other_make_few_pairs(spark, monkeypatch):
    """600 texts, most of which are too far from the base and from each other: no more pairs are verified than one per band and text, of 180,300."""
    random.seed(5)
    base = [f"b{i}" for i in range(200)]
    texts = [" ".join(base)] + [" ".join(edited(base, random.randint(5, 8))) for _ in range(600)]
    verified, checked = near_copies._verified, []
    monkeypatch.setattr(near_copies, "_verified", lambda pairs, *rest: checked.append(pairs.count()) or verified(pairs, *rest))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = homes(dict(enumerate(texts)))
    assert {r.doc_id for r in near_copies.keep_one(df).collect()} == set(want.values())
    assert sum(checked) < near_copies.BANDS * len(texts)


def test_simhash_links_are_made_first(spark, monkeypatch):
    """Texts whose SimHashes are within two bits are verified first, and what they join is not compared again; texts further apart are linked all the same."""
    from hashlib import md5

    random.seed(8)
    texts = []
    for n in (300, 500):
        base = [f"b{random.randrange(10**6)}" for _ in range(n)]
        texts += [" ".join(base)] + [" ".join(base[:-k]) for k in (1, 2, 3)] + [" ".join(edited(base, 1)) for _ in range(8)] + [" ".join(edited(base, n // 60)) for _ in range(8)]
    node = {md5(t.encode()).digest(): t for t in texts}
    prints = {k: int(near_copies.fingerprints(h := near_copies.hashes_of(t, 5), [len(h)])[0]) & (1 << 64) - 1 for k, t in node.items()}
    near = {(a, b) for a in prints for b in prints if a > b and (prints[a] ^ prints[b]).bit_count() <= 2}
    verified, calls = near_copies._verified, []
    monkeypatch.setattr(near_copies, "_verified", lambda pairs, *rest: calls.append({(bytes(r.a), bytes(r.b)) for r in pairs.collect()}) or verified(pairs, *rest))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = homes(dict(enumerate(texts)))
    assert {r.doc_id for r in near_copies.keep_one(df).collect()} == set(want.values())
    joined = homes_of(near)
    assert calls[0] and homes_of(calls[0]) == joined
    assert any(calls[1:]) and not [p for later in calls[1:] for p in later if joined.get(p[0], p[0]) == joined.get(p[1], p[1])]


def homes_of(pairs):
    home = {x: x for p in pairs for x in p}
    moved = True
    while moved:
        moved = False
        for a, b in pairs:
            low = min(home[a], home[b])
            moved |= (home[a], home[b]) != (low, low)
            home[a] = home[b] = low
    return home


def test_only_beginnings_of_differences_become_rows(spark, monkeypatch):
    """Members that differ from the base and from each other: most of what they lack or add is never a row, and rows grow with the members, not with pairs."""
    random.seed(6)
    base = [f"b{i}" for i in range(200)]
    texts = [" ".join(base)] + [" ".join(edited(base, random.randint(5, 12))) for _ in range(150)]
    stored, rows = near_copies.stored, {"differences": [], "beginnings": [], "whole": []}

    def counted(df, what):
        out = stored(df, what)
        if what in rows:
            rows[what].append(out.count())
        if what == "differences":
            rows["whole"].append(out.selectExpr("sum(n_d)").first()[0])
        return out

    monkeypatch.setattr(near_copies, "stored", counted)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = homes(dict(enumerate(texts)))
    assert {r.doc_id for r in near_copies.keep_one(df).collect()} == set(want.values())
    assert rows["differences"] and sum(rows["beginnings"]) < 0.75 * sum(rows["whole"])
    assert max(rows["differences"]) <= len(texts)
