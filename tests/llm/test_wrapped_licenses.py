"""Licence texts as files hold them: hard-wrapped, with comment marks, list numbers and a URL on its own line."""

import textwrap

import pytest

from panelwright.llm import licenses

S = licenses.SENTENCES


def apache():
    head = textwrap.fill(f"{S['apache_header']} You may obtain a copy of the License at", 75)
    return f"Copyright 2020 X\n\n{head}\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\n{textwrap.fill(S['apache_unless'] + ' ' + S['apache_see'], 75)}"


def wrapped(*names, width=72):
    return "\n\n".join(textwrap.fill(S[n], width) for n in names)


TEXTS = {
    "mit-text": wrapped("mit_grant", "mit_notice"),
    "gpl3-header": textwrap.fill(f"{S['gpl_free']} {S['gpl_hope']} {S['gpl_see']}", 70),
    "gpl2-header": wrapped("gpl2_free", "gpl_hope", "gpl_see"),
    "apache-header": apache(),
    "bsd3-text": "\n\n".join([textwrap.fill(S["bsd_grant"], 76), *(textwrap.fill(f"{i}. {S[n]}", 76, subsequent_indent="   ") for i, n in enumerate(("bsd_source", "bsd_binary", "bsd_endorse"), 1))]),
    "bsd2-text": wrapped("bsd_grant", "bsd_source", "bsd_binary"),
    "isc-text": wrapped("isc_grant"),
}
MARKS = {"plain": lambda t: t, "stars": lambda t: "/*\n" + "\n".join(f" * {x}".rstrip() for x in t.split("\n")) + "\n */", "hash": lambda t: "\n".join(f"# {x}".rstrip() for x in t.split("\n")), "slashes": lambda t: t.replace("\n", "\r\n// ")}


@pytest.mark.parametrize("marks", list(MARKS))
def test_wrapped_texts(spark, marks):
    df = spark.createDataFrame([(n, "Some code.\n\n" + MARKS[marks](t) + "\n\nint x = 1;") for n, t in TEXTS.items()], "doc_id string, text string")
    assert {r.doc_id: r.rules for r in licenses.scan_licenses(df).collect()} == {n: n for n in TEXTS}


def test_paragraphs_are_not_joined(spark):
    a, b = S["isc_grant"].split(" for any ")
    texts = [f"{a}\n\nfor any {b}", f"We say: {a}\nfor any {b}", f"{a}.\nfor any {b}"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert all(r.rules == "" for r in licenses.scan_licenses(df).collect())
