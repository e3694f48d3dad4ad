"""Licence scans: normalised text against templates by the Dice coefficient of word bigrams.

A document is compared as a whole and in each of its paragraphs and lines, as notices often stand
inside other text. Dice is twice the shared bigrams over the sum of both counts, so a template
can reach the threshold only if the counts are within a fixed ratio; all others are pruned before
any bigram is compared. One pass over the texts, no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

# Public licence notices.
_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS
BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:"""
_MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed
to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met:"""
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", _APACHE),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", _MIT_GRANT),
    ("MIT", f"{_MIT_GRANT} {_MIT_NOTICE} {_WARRANTY}"),
    ("ISC", _ISC),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD", _BSD),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", _GPL.format(v=3)),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", _GPL.format(v=2)),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", _MPL),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


def template_bigrams(text: str) -> list[str]:
    """Distinct bigrams of a template in ASCII, normalised as texts are."""
    words = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _words(text: Column) -> Column:
    plain = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(plain, r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _bigrams(words: Column) -> Column:
    ends = F.sequence(F.lit(1), F.size(words) - 1)
    return F.array_distinct(F.transform(ends, lambda i: F.concat(F.get(words, i - 1), F.lit(" "), F.get(words, i))))


def matches(text: Column, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> Column:
    """Units of a text that match a licence: an array of ``similarity, license, unit``.

    ``unit`` is ``document``, ``paragraph`` or ``line``; of each unit the best template counts,
    ties go to the later name. Null, empty and one-word texts match nothing.
    """
    known = [(name, template_bigrams(body)) for name, body in (TEMPLATES if templates is None else templates)]
    least = min((threshold / (2 - threshold) * len(b) for _, b in known), default=0)
    rows = F.array(
        *[F.struct(F.lit(n).alias("license"), F.lit(len(b)).alias("size"), F.array(*map(F.lit, b)).alias("bigrams")) for n, b in known]
    )

    def best(bigrams: Column, unit: Column) -> Column:
        size = F.size(bigrams)
        near = F.filter(rows, lambda t: 2 * F.least(t.size_of, size) >= threshold * (t.size_of + size))
        scored = F.transform(
            near,
            lambda t: F.struct(
                (F.lit(2.0) * F.size(F.array_intersect(t.bigrams, bigrams)) / (t.size_of + size)).alias("similarity"),
                t.license.alias("license"),
                unit.alias("unit"),
            ),
        )
        return F.array_max(F.filter(scored, lambda s: s.similarity >= threshold))

    rows = F.transform(rows, lambda t: F.struct(t.license.alias("license"), t["size"].alias("size_of"), t.bigrams.alias("bigrams")))

    def units(t: Column) -> Column:
        def named(parts: Column, kind: str) -> Column:
            return F.transform(parts, lambda p: F.struct(F.lit(kind).alias("unit"), p.alias("body")))

        blocks, lines = F.split(t, r"\n[ \t\r]*\n"), F.split(t, "\n")
        several = F.when(F.size(blocks) > 1, named(blocks, "paragraph")).otherwise(F.slice(named(blocks, "paragraph"), 1, 0))
        single = F.when(F.size(lines) > 1, named(lines, "line")).otherwise(F.slice(named(lines, "line"), 1, 0))
        return F.concat(named(F.array(t), "document"), several, single)

    def found(u: Column) -> Column:
        return _let(
            _words(u.body),
            lambda w: F.when((F.size(w) > 1) & (F.size(w) - 1 >= least), _let(_bigrams(w), lambda b: best(b, u.unit))),
        )

    return F.filter(F.transform(units(F.coalesce(text, F.lit(""))), found), lambda m: m.isNotNull())


def scan(docs: DataFrame, text: str = "text", templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``license_matches``; repeated rows get equal results."""
    return docs.withColumn("license_matches", matches(F.col(f"`{text}`"), templates, threshold))


def oracle(threshold: float = THRESHOLD) -> str:
    """DuckDB SQL for one row per document: its best match, how many units match, and all names."""
    rows = ", ".join(
        "(" + f"'{name}', [" + ", ".join(f"'{b}'" for b in template_bigrams(body)) + "])" for name, body in TEMPLATES
    )
    return f"""
      WITH t(license, bigrams) AS (VALUES {rows}),
      u AS (
        SELECT doc_id, 'document' AS unit, 0 AS n, text AS body FROM documents
        UNION ALL SELECT doc_id, 'paragraph', unnest(range(len(p))), unnest(p)
          FROM (SELECT doc_id, regexp_split_to_array(text, '\\n[ \\t\\r]*\\n') AS p FROM documents) WHERE len(p) > 1
        UNION ALL SELECT doc_id, 'line', unnest(range(len(p))), unnest(p)
          FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents) WHERE len(p) > 1),
      w AS (
        SELECT doc_id, unit, n, list_filter(regexp_split_to_array(
          translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM u),
      b AS (
        SELECT doc_id, unit, n, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM w WHERE len(w) > 1),
      s AS (
        SELECT doc_id, unit, n, license, 2.0::DOUBLE * len(list_intersect(bigrams, b)) / (len(bigrams) + len(b)) AS similarity
        FROM b JOIN t ON 2 * least(len(bigrams), len(b)) >= {threshold} * (len(bigrams) + len(b))),
      best AS (
        SELECT doc_id, unit, n, max({{'similarity': similarity, 'license': license, 'unit': unit}}) AS m
        FROM s WHERE similarity >= {threshold} GROUP BY doc_id, unit, n),
      per AS (
        SELECT doc_id, max(m) AS m, count(*) AS n, string_agg(DISTINCT m.license, ',' ORDER BY m.license) AS names FROM best GROUP BY doc_id)
      SELECT d.doc_id, per.m.license AS license, per.m.similarity AS similarity, per.m.unit AS unit,
        coalesce(per.n, 0)::INTEGER AS n_matches, coalesce(per.names, '') AS licenses
      FROM documents d LEFT JOIN per ON d.doc_id = per.doc_id
    """
