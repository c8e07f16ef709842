"""License scans by canonical digest lookup (operator 5): DataFrame functions only."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pairs of equivalent spellings, the first replaced by the second after lower-casing.
SPELLINGS = (
    ("licence", "license"),
    ("licencing", "licensing"),
    ("sub-license", "sublicense"),
    ("sub license", "sublicense"),
    ("non-infringement", "noninfringement"),
    ("merchantibility", "merchantability"),
    ("per cent", "percent"),
    ("whilst", "while"),
    ("acknowledgement", "acknowledgment"),
    ("judgement", "judgment"),
    ("organisation", "organization"),
    ("recognise", "recognize"),
    ("authorisation", "authorization"),
    ("favour", "favor"),
    ("copyright owner", "copyright holder"),
    ("https://", "http://"),
)
#: Entire public licence texts, one file for each, named by its identifier.
TEXTS = Path(__file__).with_name("license_texts")
#: What follows this line in a licence text tells how to apply it, and is often left out.
TERMS_END = "END OF TERMS AND CONDITIONS"


def whole_texts() -> tuple[tuple[str, str], ...]:
    """Identifier and text of each file of ``TEXTS``, and its terms alone where an appendix follows them."""
    found = []
    for file in sorted(TEXTS.glob("*.txt")):
        text = file.read_text(encoding="utf-8")
        terms, end, _ = text.partition(TERMS_END)
        found += [(file.stem, text), *([(file.stem, terms + end), (file.stem, terms)] if end else [])]
    return tuple(found)


#: Public licence texts and notices, as identifier and text without copyright lines.
_MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_BSD_TAIL = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_TAIL = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
LICENSES = (
    ("MIT", _MIT_GRANT),
    ("MIT", "MIT License\n" + _MIT_GRANT),
    ("MIT", "The MIT License (MIT)\n" + _MIT_GRANT),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-2-Clause", "BSD 2-Clause License\n" + _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    ("BSD-3-Clause", "BSD 3-Clause License\n" + _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    ("ISC", _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_TAIL),
    ("ISC", "ISC License\n" + _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_TAIL),
    ("0BSD", _ISC_GRANT + ".\n" + _ISC_TAIL),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\nhttp://www.apache.org/licenses/LICENSE-2.0\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.\nYou should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("WTFPL", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.\nDO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nTERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION\n0. You just DO WHAT THE FUCK YOU WANT TO."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    *whole_texts(),
)
#: A line that states a copyright holder: the word or sign, then a year (or a place for one) or a sign.
COPYRIGHT_LINE = r"(?m)^[^\n]*(?:copyright|\(c\)|©)[ \t:,<({\[]*(?:\(c\)|©|[12][0-9]{3}|year|yyyy)[^\n]*$"
RESERVED_LINE = r"(?m)^[^\nA-Za-z0-9]*all rights reserved[^\nA-Za-z0-9]*$"
PUNCTUATION = r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"


def _canonical_line(line: F.Column) -> F.Column:
    t = F.lower(line)
    held = F.contains(t, F.lit("copyright")) | F.contains(t, F.lit("(c)")) | F.contains(t, F.lit("©"))
    t = F.when(held, F.regexp_replace(t, COPYRIGHT_LINE, "")).otherwise(t)
    t = F.when(F.contains(t, F.lit("reserved")), F.regexp_replace(t, RESERVED_LINE, "")).otherwise(t)
    for old, new in SPELLINGS:
        t = F.replace(t, F.lit(old), F.lit(new))
    return F.trim(F.regexp_replace(t, PUNCTUATION, " "))


def canonical_lines(text: F.Column) -> F.Column:
    """Lines in lower case and one spelling, with runs of white space and ASCII punctuation as one blank; copyright lines are empty."""
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), _canonical_line)


def digest(canonical: F.Column) -> F.Column:
    """Never null, so that a join needs no second look at it."""
    return F.coalesce(F.sha2(canonical.cast("binary"), 256), F.lit(""))


def whole(lines: F.Column) -> F.Column:
    """The canonical text: its non-empty canonical lines with a blank between."""
    return F.array_join(F.filter(lines, lambda x: x != ""), " ")


def known_digests(spark: SparkSession, licenses: tuple[tuple[str, str], ...] = LICENSES) -> DataFrame:
    """``license_digest, license``: one row for each known canonical text; as small as the list above."""
    known = spark.createDataFrame(list(licenses), "license string, text string")
    return known.select(digest(whole(canonical_lines(F.col("text")))).alias("license_digest"), "license").groupBy("license_digest").agg(F.min("license").alias("license"))


def scan_licenses(docs: DataFrame, *, licenses: tuple[tuple[str, str], ...] = LICENSES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: ``doc_id, digest, license, notices``.

    ``digest`` is that of the whole canonical text, and ``license`` the known license with this digest
    (null: none).  ``notices`` lists, in order and joined by commas, the licenses whose whole text or notice is a line of
    the document (empty: none); the lines go through the same lookup.  A text is made canonical once,
    line by line; only ids and digests are shuffled.  The table of known digests
    is the one broadcast side: its size is that of the fixed list.  A null text counts as empty and
    matches nothing; null ids are carried; repeated rows come out as often as they come in; an
    empty table gives no rows.
    """
    spark = docs.sparkSession
    known = F.broadcast(known_digests(spark, licenses))
    src = docs.select(F.col(id_col).alias("doc_id"), canonical_lines(F.col(text_col).cast("string")).alias("lines"))
    lines = src.select("doc_id", digest(whole(F.col("lines"))).alias("digest"), F.posexplode("lines").alias("at", "line"))
    met = lines.select("doc_id", "digest", "at", digest(F.col("line")).alias("license_digest")).join(known, "license_digest", "left")
    rows = met.groupBy("doc_id", "digest").agg(F.count_if(F.col("at") == 0).alias("_rows"), F.array_join(F.sort_array(F.collect_set("license")), ",").alias("notices"))
    rows = rows.join(known.withColumnRenamed("license_digest", "digest"), "digest", "left")
    return rows.select("doc_id", "digest", "license", "notices", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_rows"))).alias("_n")).drop("_n")
