"""Licence scan by canonical digests: texts that differ in case, punctuation, copyright notices or equivalent
spellings have one digest, and whole texts are hash-joined to the digests of known licences.

DataFrame functions only. Defined results: a null or empty text, or one without letters and digits, has a null
digest and no licence; repeated rows are looked up each; other columns are ignored.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Equivalent spellings and their canonical form, as words of lower-case text.
SPELLINGS = {
    "licence": "license",
    "licenced": "licensed",
    "sub license": "sublicense",
    "sub licence": "sublicense",
    "non infringement": "noninfringement",
    "copyright holder": "copyright owner",
    "copyright holders": "copyright owners",
    "merchantibility": "merchantability",
    "https": "http",
    "per cent": "percent",
    "fulfil": "fulfill",
    "acknowledgement": "acknowledgment",
    "favour": "favor",
    "behaviour": "behavior",
    "organisation": "organization",
    "redistribution s": "redistributions",
}
#: A copyright notice at the start of a line, to the end of its sentence or line; what follows it there stays. A point
#: behind an initial or a company's form, or within a name, ends no sentence. Java and RE2 read it alike.
NOTICE = (
    r"(?im)^[ \t]*(?:copyright[ \t:]*(?:\(c\)|©|by[ \t]|<|\[|\{|[^\n.]{0,80}[0-9]{4})|\(c\)[ \t]*[0-9]{4}|©)"
    r"(?:\b(?:[a-z]|inc|ltd|co|corp|llc|jr|sr|dr|st)\.|[^\n.]|\.[^\s.])*(?:\.|$)"
)
#: A phrase that goes wherever it stands.
RESERVED = r"(?i)\ball rights reserved\b"

#: Short licences and standard notices.
KNOWN = {
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "MIT-notice": "Released under the MIT License.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
}
#: Full texts as published, one file a licence; the driver alone reads them.
KNOWN |= {p.stem: p.read_text(encoding="utf-8") for p in sorted((Path(__file__).resolve().parent / "license_texts").glob("*.txt"))}


def canonical(text: Column) -> Column:
    """Copyright notices out, lower case, letters and digits alone, equivalent spellings as one."""
    c = F.regexp_replace(F.regexp_replace(text, NOTICE, ""), RESERVED, " ")
    c = F.concat(F.lit(" "), F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    for a, b in SPELLINGS.items():
        c = F.replace(c, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.trim(c)


def digest(text: Column) -> Column:
    return F.sha2(F.nullif(canonical(text), F.lit("")), 256)


def known_digests(spark: SparkSession, known: dict[str, str] = KNOWN) -> DataFrame:
    rows = spark.createDataFrame(sorted(known.items()), "license_id string, _text string")
    return rows.groupBy(digest(F.col("_text")).alias("text_digest")).agg(F.min("license_id").alias("license_id"))


def scan_licenses(docs: DataFrame, known: dict[str, str] = KNOWN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's canonical digest and the licence that its whole text is, if any.

    The known side is the caller's dictionary, so its size is checked before it is broadcast."""
    if sum(map(len, known.values())) > 64 << 20:
        right = known_digests(docs.sparkSession, known)
    else:
        right = F.broadcast(known_digests(docs.sparkSession, known))
    left = docs.select(F.col(id_col), digest(F.col(text_col)).alias("text_digest"))
    return left.join(right, "text_digest", "left").select(id_col, "text_digest", "license_id", F.col("license_id").isNotNull().alias("is_license"))


def op7_license_scan(spark, sf_dir):
    from cladeflow.runtime import table

    return scan_licenses(table(spark, sf_dir, "documents"))


def _sql(text: str) -> str:
    c = f"' ' || regexp_replace(lower(regexp_replace(regexp_replace({text}, '{NOTICE}', '', 'g'), '{RESERVED}', ' ', 'g')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g') || ' '"
    for a, b in SPELLINGS.items():
        c = f"replace({c}, ' {a} ', ' {b} ')"
    return f"sha256(nullif(trim({c}), ''))"


ORACLE = (
    "WITH k(license_id, t) AS (VALUES " + ", ".join(f"('{k}', '{v.replace(chr(39), chr(39) * 2)}')" for k, v in sorted(KNOWN.items())) + "), "
    f"kd AS (SELECT {_sql('t')} AS text_digest, min(license_id) AS license_id FROM k GROUP BY 1), "
    f"d AS (SELECT doc_id, {_sql('text')} AS text_digest FROM documents) "
    "SELECT doc_id, d.text_digest, license_id, license_id IS NOT NULL AS is_license FROM d LEFT JOIN kd ON d.text_digest = kd.text_digest"
)
