"""Licence lookup by the digest of a canonical text.

Canonical form: lower case, copyright lines taken out, equivalent spellings made one,
punctuation and white space made single spaces. The SHA-256 of a document's whole
canonical text is joined with the digests of known licences; so is each line's, as
documents often carry a one-line notice. Known digests are made from the texts below
by the same expressions. They are a fixed table of a few rows, so the join broadcasts
it and no document is shuffled.

Defined cases: a null text counts as empty, whose canonical form is empty and matches
nothing. Only copyright lines: empty too. Repeated rows each have their result. An
empty table gives an empty result. Further columns play no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# Public licence texts and notices, without their copyright lines.
_MIT_BODY = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
_ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted"""
_ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""
_BSD_START = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution.
"""
_BSD_NAME = """
3. Neither the name of the copyright holder nor the names of its
contributors may be used to endorse or promote products derived from
this software without specific prior written permission.
"""
_BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not
claim that you wrote the original software. If you use this software
in a product, an acknowledgment in the product documentation would be
appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be
misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""

LICENCES = [
    ("MIT", _MIT_BODY),
    ("MIT", f"MIT License\n\n{_MIT_BODY}"),
    ("MIT", f"The MIT License (MIT)\n\n{_MIT_BODY}"),
    ("ISC", f"{_ISC_GRANT}, provided that the above\ncopyright notice and this permission notice appear in all copies.\n\n{_ISC_WARRANTY}"),
    ("ISC", f"ISC License\n\n{_ISC_GRANT}, provided that the above\ncopyright notice and this permission notice appear in all copies.\n\n{_ISC_WARRANTY}"),
    ("0BSD", f"{_ISC_GRANT}.\n\n{_ISC_WARRANTY}"),
    ("BSD-2-Clause", f"{_BSD_START}{_BSD_END}"),
    ("BSD-2-Clause", f"BSD 2-Clause License\n\n{_BSD_START}{_BSD_END}"),
    ("BSD-3-Clause", f"{_BSD_START}{_BSD_NAME}{_BSD_END}"),
    ("BSD-3-Clause", f"BSD 3-Clause License\n\n{_BSD_START}{_BSD_NAME}{_BSD_END}"),
    ("Zlib", _ZLIB),
    ("Zlib", f"zlib License\n\n{_ZLIB}"),
    ("Apache-2.0", _APACHE_NOTICE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
]

# Equivalent spellings, as whole words of lower-case text.
SPELLINGS = [
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("licence", "license"),
    ("sublicence", "sublicense"),
    ("sub license", "sublicense"),
    ("acknowledgement", "acknowledgment"),
    ("merchantibility", "merchantability"),
    ("non infringement", "noninfringement"),
    ("https", "http"),
    ("copyright owner", "copyright holder"),
    ("organisation", "organization"),
    ("whilst", "while"),
    ("wilful", "willful"),
    ("favour", "favor"),
]
COPYRIGHT_LINE = r"(?m)^[ \t]*((copyright|copr\.?)[ \t]+(\(c\)|©|[0-9]{4})|\(c\)|©|all rights reserved)[^\n]*$"


def canonical(text: F.Column) -> F.Column:
    """Lower-case words parted by single spaces; each word has spaces of its own while spellings are replaced."""
    out = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, " ")
    out = F.concat(F.lit(" "), F.regexp_replace(out, r"[^a-z0-9\x{80}-\x{10FFFF}]+", "  "), F.lit(" "))
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(f" {old.replace(' ', '  ')} "), F.lit(f" {new} "))
    return F.trim(F.regexp_replace(out, r" +", " "))


def digest(text: F.Column) -> F.Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def known(spark: SparkSession, texts: list[tuple[str, str]] = LICENCES) -> DataFrame:
    """licence and canonical digest of each known text, once per digest."""
    return spark.createDataFrame(texts, "licence string, text string").groupBy(digest(F.col("text")).alias("digest")).agg(F.min("licence").alias("licence"))


def scanned(spark: SparkSession, docs: DataFrame, texts: list[tuple[str, str]] = LICENCES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for every document: id, canonical_sha256, licence (null: none), notices.

    `notices` joins the licences of single lines, sorted and distinct, with commas. Every
    line is canonicalised and looked up by its digest.
    """
    whole = known(spark, texts)
    rows = {r["digest"]: r["licence"] for r in known(spark, [t for t in texts if "\n" not in t[1]]).collect()}  # a few notices
    names = F.create_map(*(F.lit(x) for item in rows.items() for x in item)) if rows else F.create_map().cast("map<string,string>")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("t"))
    found = F.transform(F.split("t", "\n"), lambda x: F.try_element_at(names, digest(x)))
    notices = F.array_join(F.array_sort(F.array_distinct(F.filter(found, lambda x: x.isNotNull()))), ",")
    keyed = rows.select("id", digest(F.col("t")).alias("digest"), notices.alias("notices"))
    return keyed.join(F.broadcast(whole), "digest", "left").select("id", F.col("digest").alias("canonical_sha256"), "licence", "notices")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence of every document, whole and by line."""
    return scanned(spark, common.documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def _sql_digest(text: str) -> str:
    line = COPYRIGHT_LINE.replace("(?m)", "")
    out = f"regexp_replace(lower({text}), '(?m){line}', ' ', 'g')"
    out = f"' ' || regexp_replace({out}, '[^a-z0-9\\x{{80}}-\\x{{10FFFF}}]+', '  ', 'g') || ' '"
    for old, new in SPELLINGS:
        out = f"replace({out}, ' {old.replace(' ', '  ')} ', ' {new} ')"
    return f"sha256(trim(regexp_replace({out}, ' +', ' ', 'g')))"


_VALUES = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in LICENCES)
OP7_SQL = f"""
WITH texts(licence, body) AS (VALUES {_VALUES}),
known AS (SELECT {_sql_digest('body')} AS digest, min(licence) AS licence FROM texts GROUP BY 1),
notices AS (SELECT {_sql_digest('body')} AS digest, min(licence) AS licence FROM texts WHERE NOT contains(body, chr(10)) GROUP BY 1),
docs AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
lines AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM docs),
hits AS (SELECT r, string_agg(DISTINCT licence, ',' ORDER BY licence) AS notices
         FROM lines JOIN notices ON {_sql_digest('line')} = notices.digest GROUP BY r)
SELECT d.doc_id, {_sql_digest('d.t')} AS canonical_sha256, k.licence, coalesce(h.notices, '') AS notices
FROM docs d LEFT JOIN known k ON k.digest = {_sql_digest('d.t')} LEFT JOIN hits h ON h.r = d.r
"""
