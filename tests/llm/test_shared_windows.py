"""Leaving out windows by hash before the suffix sort changes no decision."""

import random

import numpy as np
import pyarrow as pa
import pytest

from panelwright.llm import suffix_dedup as S


def contexts_of(texts, ids):
    """All contexts of some texts as one packed table, whatever their anchors' owners."""
    docs, numbers, raw = [], [], []
    for i, (text, own) in enumerate(zip(texts, ids)):
        docs.append((own, i))
        _, where, first, last, anchor, _ = S.anchors(np.frombuffer(text, dtype=np.uint8), np.array([len(text)]))
        for w, f, z, a in zip(where.tolist(), first.tolist(), last.tolist(), anchor.tolist()):
            numbers.append((a, f, z + S.LENGTH - f, w - f, i))
            raw.append(text[f : z + S.LENGTH])
    packed = [np.array(docs, dtype="<i8").tobytes()], [np.array(numbers, dtype="<i8").tobytes()], [b"".join(raw)]
    return pa.table(dict(zip(("docs", "numbers", "bytes"), packed)))


def rows_of(table):
    return sorted(zip(*(table.column(n).to_pylist() for n in ("_id", "tag", "windows"))))


def texts_of(seed):
    """Texts of few letters that share passages, cut and changed differently, and have repeats of their own."""
    r = random.Random(seed)
    passages = ["".join(r.choices("ab c", k=r.randint(60, 140))) for _ in range(3)]
    texts = []
    for _ in range(14):
        parts = []
        for p in r.choices(passages, k=2):
            p = p[r.randint(0, 20) : len(p) - r.randint(0, 20)]
            if r.random() < 0.5:
                at = r.randrange(len(p))
                p = p[:at] + "xé"[r.randrange(2)] + p[at + 1 :]
            parts += ["".join(r.choices("ab c", k=r.randint(0, 30))), p]
        texts.append("".join(parts).encode())
    return texts, [r.randint(1, 9) for _ in texts]


@pytest.mark.parametrize("seed", range(6))
def test_same_windows_with_and_without_the_filter(monkeypatch, seed):
    texts, ids = texts_of(seed)
    table = contexts_of(texts, ids)
    filtered = rows_of(S._sort_contexts(table))
    monkeypatch.setattr(S, "SORT_SYMBOLS", 500)
    in_slices = rows_of(S._sort_contexts(table))
    monkeypatch.setattr(S, "_shared", lambda rows, data, ids: rows)
    assert filtered == in_slices == rows_of(S._sort_contexts(table))
    found = {(i, t): set(np.frombuffer(w, dtype="<u8").tolist()) for i, t, w in filtered}
    for t, (text, own) in enumerate(zip(texts, ids)):
        lesser = [x for x, other in zip(texts, ids) if other < own]
        expected = {at for at in range(len(text) - S.LENGTH + 1) if any(text[at : at + S.LENGTH] in x for x in lesser)}
        assert found.get((own, t), set()) == expected


def test_no_shared_window_leaves_nothing_to_sort():
    texts = [bytes(range(33, 120)), bytes(range(119, 32, -1))]
    assert S._sort_contexts(contexts_of(texts, [1, 2])).num_rows == 0


def test_whole_anchors_stay_together():
    anchors = np.array([1, 1, 2, 3, 3, 3, 4])
    numbers = np.column_stack([anchors, anchors * 0, anchors * 0 + 60])
    slices = list(S._whole_anchors(numbers, 70))
    assert np.array_equal(np.concatenate(slices), numbers)
    assert [set(x[:, 0].tolist()) for x in slices] == [{1}, {2, 3}, {4}]
