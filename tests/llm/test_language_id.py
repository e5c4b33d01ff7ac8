"""Language ID: accuracy on held-out documents, gradients against differences, the fast reader against the trained form, odd input."""

import zlib

import numpy as np
import pytest

from conftest import SMALL
from panelwright.llm import language_id
from panelwright.llm.language_id import ByteNet, Reader, as_windows
from panelwright.llm.queries import QUERIES


def test_held_out_accuracy(spark):
    folder = SMALL.replace("sf0.001", "sf0.01")
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op12_language_id"](spark, folder).collect()
    assert {r.doc_id for r in rows} == set(langs) and len(rows) == len(langs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r.lang_pred == langs[r.doc_id] for r in rows if r.held_out]
    assert len(held) > 150 and np.mean(held) > 0.98


def test_gradients_against_differences():
    draw = np.random.default_rng(1)
    net = ByteNet(3)
    for p in net.parameters():
        p[...] = draw.normal(0, 0.5, p.shape)
    x, y = draw.integers(0, 4, (6, 20)).astype(np.uint8), np.array([0, 1, 2, 0, 1, 2])

    def loss():
        hidden = np.maximum(net._read(x)[0].astype(np.float64), 0)
        return -language_id.log_softmax(hidden @ net.out + net.out_bias)[np.arange(6), y].mean()

    for p, g in zip(net.parameters(), net.gradients(x, y)):
        flat = p.reshape(-1)
        for at in np.argsort(-np.abs(g).reshape(-1))[:3]:
            before = flat[at]
            flat[at] = before + 1e-2
            up = loss()
            flat[at] = before - 1e-2
            down = loss()
            flat[at] = before
            assert g.reshape(-1)[at] == pytest.approx((up - down) / 2e-2, abs=2e-2)


def test_reader_equals_network():
    net = ByteNet(4)
    x = as_windows([b"some text here", b"", "é ñ ß".encode() * 40])
    hidden = np.maximum(net._read(x)[0], 0)
    want = language_id.log_softmax(hidden @ net.out + net.out_bias)
    assert np.allclose(Reader(net).log_probabilities(x), want, atol=1e-5)


def labelled():
    rows = []
    for i in range(160):
        words = ["the quick house", "and with them"] if i % 2 else ["der schnelle Hund", "und nicht mehr"]
        rows.append((i, f"{words[i % 4 // 2]} {words[0]} {i} " * 8, "en" if i % 2 else "de", "x"))
    return rows


def test_odd_input(spark):
    odd = [(500, None, "en", "x"), (501, "", None, "x"), (502, "123 !? ²½", "de", "x"), (None, "the quick house and with them", None, "x")]
    odd += [(503, "the quick house and with them " * 20_000, None, "x"), (504, "der schnelle Hund und nicht mehr", None, None), (504, "der schnelle Hund und nicht mehr", None, None)]
    df = spark.createDataFrame(labelled() + odd, "doc_id bigint, text string, lang string, score string")
    rows = language_id.identify_languages(df).collect()
    assert len(rows) == 167
    got = {r.doc_id: (r.lang_pred, r.score) for r in rows}
    assert [got[i] for i in (500, 501, 502)] == [("und", 0.0)] * 3
    assert [got[i][0] for i in (None, 503, 504)] == ["en", "en", "de"] and sum(r.doc_id == 504 for r in rows) == 2
    assert [r.held_out for r in rows if r.doc_id is None] == [False]
    assert language_id.identify_languages(df.limit(0)).count() == 0
    none = language_id.identify_languages(df.where("lang is null")).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)}
    one = language_id.identify_languages(df.where("lang = 'de' or lang is null")).collect()
    assert {(r.lang_pred, r.score) for r in one} == {("de", 1.0), ("und", 0.0)}


def test_labels_of_held_out_rows_are_not_learned(spark):
    """Changing language labels, ids' order and sources where they must not count changes no prediction."""
    df = spark.createDataFrame(labelled(), "doc_id bigint, text string, lang string, source string")
    held = language_id.remainder(df.doc_id) == 2
    from pyspark.sql import functions as F

    other = df.withColumn("lang", F.when(held, F.lit("zz")).otherwise(F.col("lang"))).withColumn("source", F.lit("y"))
    a, b = (sorted(map(tuple, language_id.identify_languages(x).collect())) for x in (df, other))
    assert a == b


def test_sample_is_bounded(spark):
    df = spark.createDataFrame(labelled(), "doc_id bigint, text string, lang string, source string")
    rows = language_id.training_windows(df, "doc_id", "text", "lang", 7).collect()
    assert [r.lang for r in rows] == ["de"] * 7 + ["en"] * 7
    assert all(1 <= len(r.windows) <= language_id.PER_TEXT for r in rows)
