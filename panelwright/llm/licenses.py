"""Licence scan by sentences, in DataFrame functions only.

A text is cut into sentences, each normalised to lower-case words, and known sentences become identifiers. Ordered rules, longest sequences first,
are then matched against the sequence of identifiers; a match uses its sentences up, so a later and shorter rule cannot claim them.
Lines end sentences; but a known sentence wrapped over several lines of a paragraph, with or without comment marks, is joined first. The URL of a
sentence may stand apart on a line of its own, and a list number before a known sentence does not count.
The tables of sentences and rules are fixed and small; nothing is shuffled.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import ascii_lower, text_or_empty

BREAKS = r"[.!?]+[ \t\r\n]+|\n"
STOP = "\x01"
UNKNOWN = "<?>"

# Sentences of public licence texts and notices.
SENTENCES = {
    "mit_title": "The MIT License (MIT)",
    "mit_title_short": "MIT License",
    "mit_released": "Released under the MIT License.",
    "mit_licensed": "Licensed under the MIT License.",
    "mit_grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit_notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "apache_title": "Apache License, Version 2.0",
    "apache_licensed": "Licensed under the Apache License, Version 2.0.",
    "apache_header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "apache_copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache_unless": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "apache_see": "See the License for the specific language governing permissions and limitations under the License.",
    "bsd_grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd_source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd_binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd_endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd_licensed": "Licensed under the BSD 3-Clause License.",
    "gpl3_licensed": "This work is licensed under the GNU General Public License, version 3.",
    "gpl_free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2_free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl_hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl_see": "See the GNU General Public License for more details.",
    "lgpl_licensed": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "mpl_terms": "This Source Code Form is subject to the terms of the Mozilla Public License, v.",
    "mpl_number": "2.0.",
    "isc_grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "cc_by": "Licensed under CC BY 4.0.",
    "cc_by_long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc_by_sa": "Licensed under CC BY-SA 4.0.",
    "cc_by_sa_long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc_by_nc": "Licensed under CC BY-NC 4.0.",
    "cc_by_nc_long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc_by_nd": "Licensed under CC BY-ND 4.0.",
    "all_rights": "All rights reserved.",
}

# Fixed values: (rule, licence, class, sentences in order).
RULES = (
    ("gpl3-header", "GPL-3.0-or-later", "copyleft", ("gpl_free", "gpl_hope", "gpl_see")),
    ("gpl2-header", "GPL-2.0-or-later", "copyleft", ("gpl2_free", "gpl_hope", "gpl_see")),
    ("apache-header", "Apache-2.0", "permissive", ("apache_header", "apache_copy", "apache_unless", "apache_see")),
    ("bsd3-text", "BSD-3-Clause", "permissive", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse")),
    ("bsd2-text", "BSD-2-Clause", "permissive", ("bsd_grant", "bsd_source", "bsd_binary")),
    ("mit-text-titled", "MIT", "permissive", ("mit_title", "mit_grant", "mit_notice")),
    ("mit-text", "MIT", "permissive", ("mit_grant", "mit_notice")),
    ("gpl3-start", "GPL-3.0-or-later", "copyleft", ("gpl_free",)),
    ("gpl2-start", "GPL-2.0-or-later", "copyleft", ("gpl2_free",)),
    ("gpl3-notice", "GPL-3.0-only", "copyleft", ("gpl3_licensed",)),
    ("lgpl3-notice", "LGPL-3.0-only", "copyleft", ("lgpl_licensed",)),
    ("mpl-notice", "MPL-2.0", "copyleft", ("mpl_terms", "mpl_number")),
    ("apache-start", "Apache-2.0", "permissive", ("apache_header",)),
    ("apache-notice", "Apache-2.0", "permissive", ("apache_licensed",)),
    ("apache-title", "Apache-2.0", "permissive", ("apache_title",)),
    ("mit-notice", "MIT", "permissive", ("mit_released",)),
    ("mit-notice-2", "MIT", "permissive", ("mit_licensed",)),
    ("mit-title", "MIT", "permissive", ("mit_title",)),
    ("mit-title-short", "MIT", "permissive", ("mit_title_short",)),
    ("bsd3-notice", "BSD-3-Clause", "permissive", ("bsd_licensed",)),
    ("isc-text", "ISC", "permissive", ("isc_grant",)),
    ("unlicense-text", "Unlicense", "permissive", ("unlicense",)),
    ("cc0-text", "CC0-1.0", "permissive", ("cc0",)),
    ("cc-by", "CC-BY-4.0", "permissive", ("cc_by",)),
    ("cc-by-text", "CC-BY-4.0", "permissive", ("cc_by_long",)),
    ("cc-by-sa", "CC-BY-SA-4.0", "copyleft", ("cc_by_sa",)),
    ("cc-by-sa-text", "CC-BY-SA-4.0", "copyleft", ("cc_by_sa_long",)),
    ("cc-by-nc", "CC-BY-NC-4.0", "restricted", ("cc_by_nc",)),
    ("cc-by-nc-text", "CC-BY-NC-4.0", "restricted", ("cc_by_nc_long",)),
    ("cc-by-nd", "CC-BY-ND-4.0", "restricted", ("cc_by_nd",)),
    ("all-rights", "Proprietary", "restricted", ("all_rights",)),
)
#: From the most binding to the least.
CLASSES = ("restricted", "copyleft", "permissive")


def plain(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), sentence)).strip(" ")


def known(sentences=None) -> dict[str, str]:
    """Normalised sentence -> identifier. A known sentence that holds a break itself would never be found, so it is refused."""
    out = {}
    for name, text in (sentences or SENTENCES).items():
        if re.search(BREAKS, text.rstrip()):
            raise ValueError(f"{name} is more than one sentence")
        out[plain(text)] = name
    return out


def _joined(low: Column, table: dict[str, str]) -> Column:
    """Normalised sentences between line feeds and STOPs, known ones on one line each: sentence ends and blank lines are STOPs."""
    text = F.regexp_replace(F.translate(low, STOP, " "), r"[.!?]+[ \t\r\n]+", STOP)
    text = F.regexp_replace(text, rf"(?:\n[^a-z0-9\n{STOP}]*)+(?=https?://)", "\n")
    text = F.regexp_replace(text, rf"\n(?:[^a-z0-9\n{STOP}]*\n)+", STOP)
    text = F.regexp_replace(F.regexp_replace(text, rf"[^a-z0-9\n{STOP}]+", " "), rf" ?([\n{STOP}]) ?", "$1")
    text = F.concat(F.lit(STOP), F.trim(text), F.lit(STOP))
    for sentence in table:
        if " " in sentence and not re.fullmatch("[0-9 ]+", sentence):
            wrapped = sentence.replace(" ", r"[ \n]")
            text = F.regexp_replace(text, rf"(?<=[\n{STOP}])(?:[0-9]{{1,2}}[ \n{STOP}])?{wrapped}(?=[\n{STOP}])", sentence)
    return text


def _sequence(text: Column, table: dict[str, str]) -> Column:
    """(number of sentences with a word, identifiers joined in order) of a text."""
    names = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    low = ascii_lower(text)
    # A sentence is only there if its longest word is, so most texts are not searched.
    longest = "|".join(sorted({max(sentence.split(), key=len) for sentence in table if not re.fullmatch("[0-9 ]+", sentence)} or {"$^"}))
    parts = F.when(low.rlike(longest), F.split(_joined(low, table), rf"[\n{STOP}]")).otherwise(F.split(low, BREAKS))
    sentences = F.transform(parts, lambda s: F.trim(F.regexp_replace(s, "[^a-z0-9]+", " ")))
    worded = F.filter(sentences, lambda s: s != "")
    ids = F.transform(worded, lambda s: F.coalesce(F.concat(F.lit("<"), F.try_element_at(names, s), F.lit(">")), F.lit(UNKNOWN)))
    return F.array_join(ids, "")


def scan_licenses(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES, sentences=None) -> DataFrame:
    """A row per document: id, n_known (known sentences), rules (in text order), licenses (distinct, sorted), class (the most binding).

    A null or empty text, and one without known sentences in a rule's order, has no rules, no licences and a null class. Repeated rows and null ids are
    scanned like any other. Unknown sentences break a sequence. Other columns are not looked at.
    """
    df = documents.select(F.col(id_col), _sequence(text_or_empty(text_col), known(sentences)).alias("_s"))
    matched = F.col("_s")
    for i, (_, _, _, names) in enumerate(rules):
        matched = F.replace(matched, F.lit("".join(f"<{n}>" for n in names)), F.lit(f"<#{i}>"))
    has_any = F.col("_s").rlike("<[a-z]")
    numbers = F.when(has_any, F.regexp_extract_all(matched, F.lit("<#([0-9]+)>"), 1)).otherwise(F.array().cast("array<string>"))
    df = df.select(id_col, F.size(F.regexp_extract_all("_s", F.lit("<([a-z])"), 1)).cast("long").alias("n_known"), numbers.alias("_n"))

    def named(k: int):
        table = F.array(*[F.lit(r[k]) for r in rules])
        return F.transform("_n", lambda n: table[n.cast("int")])

    classes = named(2)
    binding = F.lit(None).cast("string")
    for name in reversed(CLASSES):
        binding = F.when(F.array_contains(classes, name), F.lit(name)).otherwise(binding)
    return df.select(
        id_col, "n_known", F.array_join(named(0), ",").alias("rules"), F.array_join(F.array_sort(F.array_distinct(named(1))), ",").alias("licenses"), binding.alias("class")
    )


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql() -> str:
    table = ", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in known().items())
    rule = ", ".join(f"({i}, {_quoted(a)}, {_quoted(b)}, {_quoted(c)})" for i, (a, b, c, _) in enumerate(RULES))
    matched = "s"
    for i, (_, _, _, names) in enumerate(RULES):
        matched = f"replace({matched}, '{''.join(f'<{n}>' for n in names)}', '<#{i}>')"
    order = " ".join(f"when bool_or(c = '{c}') then '{c}'" for c in CLASSES)
    return f"""
with known(t, name) as (values {table}), rule(i, r, l, c) as (values {rule}),
text as (select row_number() over () k, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t from documents),
part as (select k, generate_subscripts(p, 1) j, unnest(p) s from (select k, regexp_split_to_array(t, '{BREAKS}') p from text)),
word as (select k, j, trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g'), ' ') s from part),
seq as (select k, string_agg(coalesce('<' || name || '>', '{UNKNOWN}'), '' order by j) s, count(name) n from word left join known on word.s = known.t where word.s <> '' group by k),
hit as (select k, generate_subscripts(m, 1) j, unnest(m)::int i from (select k, regexp_extract_all({matched}, '<#([0-9]+)>', 1) m from seq where n > 0)),
found as (
  select k, string_agg(r, ',' order by j) rules, string_agg(distinct l, ',' order by l) licenses, case {order} end as "class"
  from hit join rule using (i) group by k)
select doc_id, coalesce(n, 0)::bigint n_known, coalesce(rules, '') rules, coalesce(licenses, '') licenses, "class"
from text left join seq using (k) left join found using (k)
"""


SQL = sql()
