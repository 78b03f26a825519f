"""License scan by canonical digest lookup.

A text's canonical form folds case, punctuation, blanks, copyright lines and spellings that
license guidelines hold equivalent; its SHA-256 is joined with the digests of known
license texts. Only DataFrame functions, and each text is normalised once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm.rows import table
from skyloom.plans.staging import stage

# License texts and notices as published by their authors.
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
}
# SHA-256 of the canonical forms of whole license texts as their authors publish them.
DIGESTS = {
    "Apache-2.0": ["0d5838e6f6e5a374e58d608af5c01bc6a67cf18552dd7b346e5aef652b808ee9"],
    "Artistic-1.0-Perl": ["f7fec2048e2502b8b653a12ac095bcb0601f72bbd1d535b2e8adf8e097d2f915"],
    "BSD-3-Clause": ["21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651"],
    "CC0-1.0": ["de4b88a2c819a4661af54f735069ed878216da8b4992b919b84afa18cfc0e54c"],
    "GFDL-1.2-only": ["19d29a7c800a0d85704b63b4c09d5cd01dd9a287c61e238f4717d8a9e75d214f"],
    "GFDL-1.3-only": ["e70f40f3a50995855f972521fe4eaa4af360a4597e5914977b6093cce5243480"],
    "GPL-1.0-only": ["9e12a40a9b22c45d116f19e1746b08ea0b853519de3e03ceb780f2a36d5f388c"],
    "GPL-2.0-only": ["b866f5427b78991db8012466b32f51c907f5e974fde5129a47372d0d0552e3a1"],
    "GPL-3.0-only": ["59a779feaae4de539260be3c8adb19c287a771586d211e12d93932777da37349"],
    "LGPL-2.0-only": ["96685b4d8003c3671feddcde58622afa814a3ac15dcc419f38b388aff5e16d1d"],
    "LGPL-2.1-only": ["22bd2802b7b313faf9750f494c8f07c9eaa0e00ba5b9f7a300e8fa36cfd1319e"],
    "LGPL-3.0-only": ["aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"],
    "MPL-1.1": ["fcb579371133afd771fed87cd5d8c6dc5648746c9945d4adf08ec5c79aba5c61"],
    "MPL-2.0": ["95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9"],
}
# One-line notices.
NOTICES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0"],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT"],
    "GPL-3.0-only": ["This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only"],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "MPL-2.0": ["Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "CC0-1.0": ["Released under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0"],
}
# Spellings held equivalent, the second of each is the canonical one.
SPELLINGS = [("licence", "license"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("sub license", "sublicense"), ("acknowledgement", "acknowledgment"), ("organisation", "organization"), ("non infringement", "noninfringement"), ("merchantibility", "merchantability"), ("whilst", "while"), ("owner", "holder"), ("https", "http")]


def canonical_lines(text) -> F.Column:
    """The text's canonical lines: an array of strings, none empty.

    Lower case; lines that begin with a copyright sign or word and lines of all rights reserved
    are dropped; all but letters and digits is one blank; equivalent spellings are one.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    low = F.regexp_replace(low, r"(?m)^[^\p{L}\p{N}\n©]*(?:copyright\b|©|\(c\)|all rights reserved)[^\n]*$", "")
    low = F.regexp_replace(low, r"[^\p{L}\p{N}\n]+", " ")
    rare = "|".join(other for other, _ in SPELLINGS)

    def one_spelling(x):
        for other, one in SPELLINGS:
            x = F.regexp_replace(x, rf"\b{other}(s?)\b", f"{one}$1")
        return x

    # a text of one element binds the normalised text, so that it is computed once
    low = F.element_at(F.transform(F.array(low), lambda x: F.when(F.rlike(x, F.lit(rare)), one_spelling(x)).otherwise(x)), 1)
    return F.filter(F.transform(F.split(low, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def digest(text) -> F.Column:
    return F.sha2(text, 256)


def known_licenses(spark: SparkSession, extra: dict[str, list[str]] | None = None) -> DataFrame:
    """``(license, digest)`` of the known texts, digests and notices, and of ``extra`` texts."""
    rows = [(k, v) for k, v in TEXTS.items()] + [(k, v) for part in (NOTICES, extra or {}) for k, vs in part.items() for v in vs]
    texts = spark.createDataFrame(rows, "license string, text string").select("license", digest(F.array_join(canonical_lines(F.col("text")), " ")).alias("digest"))
    listed = spark.createDataFrame([(k, d) for k, ds in DIGESTS.items() for d in ds], "license string, digest string")
    return texts.unionByName(listed).groupBy("digest").agg(F.min("license").alias("license"))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra: dict[str, list[str]] | None = None) -> DataFrame:
    """``(doc_id, digest, license, line_licenses)``, one row per row of ``docs``.

    ``license`` names the known text that the entire text canonically is, else null;
    ``line_licenses`` lists, in order and without repeats, those that single lines are. A null
    or empty text, or one of copyright lines only, has the digest of no words and no
    license. Null ids and repeated rows are scanned like others. An empty table gives no rows.

    Both are hash joins with the known digests, so many as this module lists, which are
    broadcast. Lines that match are gathered for each text digest, so that copies of a text,
    however many, are one row there.
    """
    known = F.broadcast(known_licenses(docs.sparkSession, extra))
    lines = docs.select(F.col(id_col).alias("doc_id"), canonical_lines(F.col(text_col)).alias("lines"))
    told = stage(lines.select("doc_id", digest(F.array_join("lines", " ")).alias("digest"), F.transform("lines", digest).alias("lines")), "license_digests")
    whole = told.select("doc_id", "digest").join(known, "digest", "left")
    named = told.select(F.col("digest").alias("whole"), F.posexplode("lines").alias("at", "digest")).join(known, "digest").groupBy("whole", "license").agg(F.min("at").alias("at"))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("at", "license"))), lambda x: x["license"])
    of_text = named.groupBy(F.col("whole").alias("digest")).agg(in_order.alias("line_licenses"))
    return whole.join(of_text, "digest", "left").select("doc_id", "digest", "license", F.coalesce("line_licenses", F.array().cast("array<string>")).alias("line_licenses"))


def op10_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def _oracle_sql() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    known = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in [*TEXTS.items(), *((k, v) for k, vs in NOTICES.items() for v in vs)])
    folded = r"""regexp_replace(regexp_replace(lower(coalesce(text, '')), '(?m)^[^\p{L}\p{N}\n©]*(?:copyright\b|©|\(c\)|all rights reserved)[^\n]*$', '', 'g'), '[^\p{L}\p{N}\n]+', ' ', 'g')"""
    for other, one in SPELLINGS:
        folded = f"regexp_replace({folded}, '\\b{other}(s?)\\b', '{one}\\1', 'g')"
    listed = ", ".join(f"({quote(k)}, {quote(d)})" for k, ds in DIGESTS.items() for d in ds)
    return f"""
WITH t AS (
  SELECT row_number() OVER () AS rid, doc_id, NULL AS license, text FROM documents
  UNION ALL SELECT NULL, NULL, license, text FROM (VALUES {known}) AS k(license, text)
), f AS (
  SELECT rid, doc_id, license, list_filter(list_transform(string_split({folded}, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines FROM t
), d AS (
  SELECT rid, doc_id, license, lines, sha256(coalesce(array_to_string(lines, ' '), '')) AS digest FROM f
), known AS (
  SELECT digest, min(license) AS license FROM (SELECT digest, license FROM d WHERE license IS NOT NULL UNION ALL SELECT digest, license FROM (VALUES {listed}) AS k(license, digest)) GROUP BY digest
), u AS (
  SELECT rid, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d WHERE license IS NULL
), n AS (
  SELECT z.rid, list(z.license ORDER BY z.pos) AS licenses FROM (
    SELECT rid, known.license, min(pos) AS pos FROM u JOIN known ON sha256(line) = known.digest GROUP BY rid, known.license) AS z GROUP BY z.rid
)
SELECT d.doc_id, d.digest, known.license, coalesce(n.licenses, []) AS line_licenses
FROM d LEFT JOIN known ON d.digest = known.digest LEFT JOIN n ON d.rid = n.rid WHERE d.license IS NULL
"""


OP10_SQL = _oracle_sql()
