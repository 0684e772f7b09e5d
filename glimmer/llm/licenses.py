"""Licence scans by canonical digests.

A text is normalised: copyright lines go, case and punctuation go, equivalent spellings become
one. The digest of the whole canonical text is then looked up, by a hash join, among
the digests of known licences and notices. The units looked up are whole documents
and each of their lines, since most documents carry their licence as a line of its own. The digests are
a table with a row for each known text, broadcast behind a count of its rows. Each known text has a word such as
license or permission, so texts without any are passed over before they are normalised: nothing is lost by it.

Defined results: a null or empty text, and a line without words, is no licence; repeated
rows are each reported; one document can have several licences, one of a kind each with
the number of its units; an empty table gives an empty result. Other columns of the input are left alone
and can have any name.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glimmer.session import table

_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_APACHE = "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
# Fixed values: (licence, text) of known licences and notices.
KNOWN = [
    ("MIT", "MIT License " + _GRANT),
    ("MIT", "The MIT License (MIT) " + _GRANT),
    ("MIT", _GRANT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", "ISC License " + _ISC + ", provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_END),
    ("ISC", _ISC + ", provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_END),
    ("0BSD", _ISC + ". " + _ISC_END),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); " + _APACHE),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
]
# Spellings that count as the same, after lower case and punctuation.
SPELLINGS = {"licence": "license", "licences": "licenses", "licenced": "licensed", "licencing": "licensing", "sublicence": "sublicense", "merchantibility": "merchantability", "noncommercial": "non commercial", "noninfringement": "non infringement", "v 2 0": "version 2 0", "organisation": "organization", "organisations": "organizations", "favour": "favor", "https": "http"}
#: Each known text has one of these (tested), in all spellings that canonical() makes one.
MARKS = r"(?i)licen[sc]|permission|permitted|waived|warrant"
MAX_BROADCAST = 1_000_000
_COPYRIGHT = r"(?im)^[^\S\n]*(?:copyright\b|\(c\)|©)[^\n]*(?:\d{4}|\(c\)|©|all rights reserved)[^\n]*$"
_PUNCTUATION = r"[^\p{L}\p{N}\n]+"


def canonical(text: Column) -> Column:
    """The canonical text; line breaks stay, so lines can still be told apart."""
    out = F.regexp_replace(text, _COPYRIGHT, "")
    out = F.regexp_replace(F.lower(out), _PUNCTUATION, " ")
    for old, new in SPELLINGS.items():
        out = F.regexp_replace(out, rf"(?<![\p{{L}}\p{{N}}]){old}(?![\p{{L}}\p{{N}}])", new)
    return F.regexp_replace(out, r"(?m)^ +| +$", "")


def may_be_known(text: Column, marks: str = MARKS) -> Column:
    """The text has a word that each known text has. Case and spelling do not matter, so no text with a known licence is passed over."""
    return text.rlike(marks)


def _one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """(license_id, digest), a row for each distinct canonical text."""
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("license_id"), F.lit(t).alias("text")) for i, t in known or KNOWN])).alias("k")
    return spark.range(1).select(rows).select("k.license_id", F.sha2(_one_line(canonical(F.col("k.text"))), 256).alias("digest")).distinct()


def scan(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", marks: str = MARKS) -> DataFrame:
    """(doc_id, license_id, unit, n_units): unit is text for a whole document, line for lines of it. With a table `known` of the
    caller's, `marks` is a pattern that each of its texts has ("" looks at all texts)."""
    known = known_digests(docs.sparkSession) if known is None else known
    if known.count() <= MAX_BROADCAST:
        known = F.broadcast(known)
    # Texts without a mark go before anything is normalised; of the others, lines without a mark go after it.
    rows = docs.where(F.length(text_col) > 0).where(may_be_known(F.col(text_col), marks)).select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("_row"), canonical(F.col(text_col)).alias("_c"))
    unit = lambda kind, t: F.struct(F.lit(kind).alias("unit"), F.sha2(t, 256).alias("digest"))
    lines = F.transform(F.filter(F.split("_c", "\n"), lambda x: (x != "") & may_be_known(x, marks)), lambda x: unit("line", x))
    # A text of one line is looked up as a whole only.
    units = F.when(F.col("_c").contains("\n"), F.concat(F.array(unit("text", _one_line(F.col("_c")))), lines)).otherwise(F.array(unit("text", _one_line(F.col("_c")))))
    # The outer form infers no filter on the array's size, for which all would be normalised once more.
    found = rows.select("doc_id", "_row", F.explode_outer(units).alias("u")).select("doc_id", "_row", "u.unit", "u.digest").join(known, "digest")
    return found.groupBy("doc_id", "_row", "license_id", "unit").agg(F.count(F.lit(1)).alias("n_units")).select("doc_id", "license_id", "unit", "n_units")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The known licences of every document that has one."""
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def canonical_text(text: str) -> str:
    """canonical() of a text in Python, in one line, for the table of digests in SQL."""
    out = re.sub(_COPYRIGHT, "", text)
    out = re.sub(r"[^\w\n]+|_+", " ", out.lower())
    for old, new in SPELLINGS.items():
        out = re.sub(rf"(?<!\w){old}(?!\w)", new, out)
    return " ".join(out.split())


def _sql() -> str:
    values = ", ".join(f"('{i}', '{d}')" for i, d in sorted({(i, hashlib.sha256(canonical_text(t).encode()).hexdigest()) for i, t in KNOWN}))
    out = "regexp_replace(lower(regexp_replace(text, '(?im)^[^\\S\\n]*(?:copyright\\b|\\(c\\)|©)[^\\n]*(?:\\d{4}|\\(c\\)|©|all rights reserved)[^\\n]*$', '', 'g')), '[^\\p{L}\\p{N}\\n]+', ' ', 'g')"
    for old, new in SPELLINGS.items():  # twice: each match takes the blank that the next one needs
        for _ in range(2):
            out = f"regexp_replace({out}, '(^|[^\\p{{L}}\\p{{N}}]){old}([^\\p{{L}}\\p{{N}}]|$)', '\\1{new}\\2', 'g')"
    return f"""
WITH k(license_id, digest) AS (VALUES {values}),
c AS (SELECT doc_id, {out} AS c FROM documents WHERE length(text) > 0),
l AS (SELECT doc_id, trim(unnest(string_split(c, chr(10)))) AS x FROM c WHERE contains(c, chr(10))),
u AS (SELECT doc_id, 'text' AS unit, sha256(trim(regexp_replace(c, '\\s+', ' ', 'g'))) AS digest FROM c
  UNION ALL SELECT doc_id, 'line', sha256(x) FROM l WHERE x <> '')
SELECT doc_id, license_id, unit, count(*)::BIGINT AS n_units FROM u JOIN k USING (digest) GROUP BY ALL
"""


OP5_SQL = _sql()
