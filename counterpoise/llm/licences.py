"""Licence scan by canonical digests.

A text is brought into canonical form (ASCII case, copyright lines, equivalent spellings, punctuation and white
space), hashed, and the hash is joined to the digests of known licence texts and notices.  Three kinds of entire
texts are looked up: the document, its blocks (between blank lines) and its lines.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import spread, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
COPYRIGHT = r"(^|\n)[ \t]*(copyright|\(c\)|©)[^\n]*"
SPELLINGS = (
    ("licence", "license"), ("licencing", "licensing"), ("sub-license", "sublicense"), ("non-commercial", "noncommercial"),
    ("non-infringement", "noninfringement"), ("organisation", "organization"), ("authorisation", "authorization"),
    ("authorised", "authorized"), ("acknowledgement", "acknowledgment"), ("favour", "favor"), ("https://", "http://"),
    ("merchantibility", "merchantability"), ("“", '"'), ("”", '"'), ("’", "'"), ("version 2.0", "v2.0"),
    ("version 3", "v3"), ("version 2", "v2"),
)
PUNCTUATION = r"[^\p{L}\p{N}\n]+"
BREAK = r"\n *(?:\n *)+"  # lines without letters and digits, once punctuation is gone
SPACES = r"[ \n]+"

# Texts and notices as their stewards publish them.
_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_TAIL = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
_ZLIB = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
_UNLICENSE = 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BOOST = 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_RESERVED = "All rights reserved."
_BSD2, _BSD3 = f"{_BSD_HEAD} {_BSD_TAIL}", f"{_BSD_HEAD} {_BSD_THIRD} {_BSD_TAIL}"
KNOWN: tuple[tuple[str, str], ...] = (
    # As they stand in files: with a title or without, and with the line that often follows the copyright line.
    *((f"BSD-{n}-Clause", f"{title}{line}{text}") for n, text in ((2, _BSD2), (3, _BSD3)) for title in ("", f"BSD {n}-Clause License ", f"The BSD {n}-Clause License ") for line in ("", f"{_RESERVED} ")),
    ("Zlib", _ZLIB), ("Zlib", f"zlib License {_ZLIB}"), ("Unlicense", _UNLICENSE), ("Unlicense", f"{_UNLICENSE} For more information, please refer to <https://unlicense.org>"), ("Unlicense", f"{_UNLICENSE} For more information, please refer to <http://unlicense.org/>"),
    ("BSL-1.0", _BOOST), ("BSL-1.0", f"Boost Software License - Version 1.0 - August 17th, 2003 {_BOOST}"),
    ("MIT", _MIT), ("MIT", f"MIT License {_MIT}"), ("MIT", f"The MIT License (MIT) {_MIT}"),
    ("ISC", f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies. {_WARRANTY}"),
    ("ISC", f"ISC License {_ISC}, provided that the above copyright notice and this permission notice appear in all copies. {_WARRANTY}"),
    ("0BSD", f"{_ISC}. {_WARRANTY}"),
    ("Apache-2.0", _APACHE),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "Released under the Apache License, Version 2.0."), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0", "Licensed under the GNU General Public License, version 3."), ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"), ("GPL-3.0-or-later", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."), ("GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-only"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC0-1.0", "Released under CC0 1.0."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"), ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("LicenseRef-all-rights-reserved", "All rights reserved."),
)


def canonical(text: Column) -> Column:
    """Canonical form of a text with its line breaks; null stays null.  ``flat`` makes one line of any part of it."""
    t = F.regexp_replace(F.translate(text, UPPER, LOWER), COPYRIGHT, "$1")
    for a, b in SPELLINGS:
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.regexp_replace(t, PUNCTUATION, " ")


def flat(part: Column) -> Column:
    return F.trim(F.regexp_replace(part, SPACES, " "))


def canonical_text(text: str) -> str:
    """The flat canonical form of one Python string (the known texts, tests)."""
    import regex

    t = re.sub(COPYRIGHT, r"\1", text.translate(str.maketrans(UPPER, LOWER)))
    for a, b in SPELLINGS:
        t = t.replace(a, b)
    return re.sub(SPACES, " ", regex.sub(PUNCTUATION, " ", t)).strip(" ")


def known_digests() -> dict[str, str]:
    """digest -> licence id; a fixed list of a few dozen entries."""
    return {hashlib.sha256(canonical_text(t).encode()).hexdigest(): i for i, t in KNOWN}


def scan(docs: DataFrame, known: dict[str, str] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text_license, unit_licenses, n_units for every row of ``docs``.

    text_license: the licence whose digest the whole text has, else null (of rows with equal keys, the last by name).  unit_licenses: the licences of its
    blocks and lines, sorted and comma-joined ('' if none); n_units: how many distinct blocks and lines matched.
    Null or empty texts match nothing.  Rows with equal keys get the union of what these rows hold; a null key
    gets an empty report.  Other columns are ignored.
    """
    spark = docs.sparkSession
    known = known_digests() if known is None else known
    list_ = spark.createDataFrame(list(known.items()) or [("-", "-")], "digest string, license string")
    list_ = F.broadcast(list_) if len(known) <= 100_000 else list_
    # Each text is brought into form once; whole text, blocks and lines are parts of that form.
    t = docs.filter(F.length(text) > 0).select(F.col(key).alias("_key"), canonical(F.col(text)).alias("_text"))
    parts = F.array_distinct(F.transform(F.concat(F.split("_text", "\n"), F.split("_text", BREAK)), flat))
    units = F.concat(F.array(F.struct(F.lit(True).alias("whole"), flat(F.col("_text")).alias("part"))), F.transform(parts, lambda x: F.struct(F.lit(False).alias("whole"), x.alias("part"))))
    rows = t.select("_key", F.explode(units).alias("u")).select("_key", "u.whole", F.col("u.part").alias("part")).filter("part <> ''")
    hits = rows.select("_key", "whole", F.sha2("part", 256).alias("digest")).join(list_, "digest")
    found = hits.groupBy("_key").agg(
        F.max(F.when(F.col("whole"), F.col("license"))).alias("text_license"),
        F.array_join(F.array_sort(F.collect_set(F.when(~F.col("whole"), F.col("license")))), ",").alias("unit_licenses"),
        F.count_distinct(F.when(~F.col("whole"), F.col("digest"))).alias("n_units"),
    )
    keys = docs.select(F.col(key).alias("_key"))
    return keys.join(found, "_key", "left").select(F.col("_key").alias(key), "text_license", F.coalesce("unit_licenses", F.lit("")).alias("unit_licenses"), F.coalesce("n_units", F.lit(0)).cast("long").alias("n_units"))


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spread(table(spark, sf_dir, "documents")))


def _sql() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"

    def form(x: str) -> str:
        x = f"regexp_replace(translate({x}, '{UPPER}', '{LOWER}'), {quote(COPYRIGHT)}, '\\1', 'g')"
        for a, b in SPELLINGS:
            x = f"replace({x}, {quote(a)}, {quote(b)})"
        return f"regexp_replace({x}, {quote(PUNCTUATION)}, ' ', 'g')"

    known = ", ".join(f"({quote(d)}, {quote(i)})" for d, i in known_digests().items())
    return f"""
WITH known(digest, license) AS (VALUES {known}),
t AS (SELECT doc_id, {form('text')} AS text FROM documents WHERE length(text) > 0),
u AS (SELECT DISTINCT doc_id, whole, trim(regexp_replace(part, {quote(SPACES)}, ' ', 'g'), ' ') AS part FROM (
  SELECT doc_id, true AS whole, text AS part FROM t
  UNION ALL SELECT doc_id, false, unnest(string_split(text, chr(10))) FROM t
  UNION ALL SELECT doc_id, false, unnest(regexp_split_to_array(text, {quote(BREAK)})) FROM t)),
f AS (SELECT doc_id, max(license) FILTER (WHERE whole) AS text_license,
    string_agg(DISTINCT license, ',' ORDER BY license) FILTER (WHERE NOT whole) AS unit_licenses,
    count(DISTINCT digest) FILTER (WHERE NOT whole) AS n_units
  FROM (SELECT doc_id, whole, sha256(part) AS digest FROM u WHERE part <> '') JOIN known USING (digest) GROUP BY doc_id)
SELECT d.doc_id, f.text_license, coalesce(f.unit_licenses, '') AS unit_licenses, coalesce(f.n_units, 0) AS n_units
FROM documents d LEFT JOIN f ON f.doc_id = d.doc_id
"""


OP3_SQL = _sql()
