"""Licence scans by canonical digest lookup, in DataFrame operations.

A text is reduced to a canonical form (ASCII lower case, copyright lines dropped, punctuation to single
spaces, equivalent spellings made one) and its MD5 digest is hash-joined to the digests of known
licence texts. The whole text is looked up, and so is each of its lines, since notices are one line long.

Known texts are the short ones below and the files of license_texts. Each also counts without its title
and without its closing instructions. A line is only reduced if it holds one of the sign words, which
cover all known texts (see sign_words), so that no line that could match is left out.
"""

from __future__ import annotations

import re
import string
from collections import Counter
from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Spellings that licence matching treats as equal, in their canonical form.
EQUIVALENT = {
    "licence": "license",
    "organisation": "organization",
    "authoris": "authoriz",
    "recognis": "recogniz",
    "acknowledgement": "acknowledgment",
    "favour": "favor",
    "judgement": "judgment",
    "merchantibility": "merchantability",
    "non commercial": "noncommercial",
    "sub license": "sublicense",
    "per cent": "percent",
    "whilst": "while",
}

_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_GRANT = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
)
_ISC_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF "
    "OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)

# Known licence texts and one-line notices by SPDX identifier.
KNOWN = [
    ("MIT", "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
     "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
     "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
     "following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
     "Software.\n\n" + _WARRANTY),
    ("ISC", "ISC License\n\n" + _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_WARRANTY),
    ("0BSD", "BSD Zero Clause License\n\n" + _ISC_GRANT + ".\n\n" + _ISC_WARRANTY),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising "
     "from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to "
     "alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must "
     "not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be "
     "appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original "
     "software.\n3. This notice may not be removed or altered from any source distribution."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
]

TEXT_FOLDER = Path(__file__).with_name("license_texts")
# Where the closing instructions of known texts begin.
CLOSINGS = ("END OF TERMS AND CONDITIONS", "APPENDIX: How to apply", "How to Apply These Terms", "Exhibit A", "For more information, please refer")

#: Whole lines that only state a copyright: the word with a sign or a year after it, or the usual reservation.
COPYRIGHT_LINE = r"^[^a-z0-9\n]*(copyright[ \t]*(\(c\)|©|[0-9]{4})|(\(c\)|©)[ \t]*(copyright|[0-9]{4})|all rights reserved[^a-z0-9\n]*$)[^\n]*$"
SIGN_LENGTH = 5
#: Characters beyond ASCII that lower() would turn into ASCII letters.
FOLDING = "\u0130\u212a"


@cache
def known_texts() -> list[tuple[str, str]]:
    """(license_id, text) of all known texts, with and without their titles and closing instructions."""
    found = [*KNOWN, *((p.stem, p.read_text("utf-8")) for p in sorted(TEXT_FOLDER.glob("*.txt")))]
    out = []
    for name, text in found:
        starts = [text, *([text.split("\n\n", 1)[1]] if re.match(r"[^\n]{1,40} License\n\n", text) else [])]
        for whole in starts:
            out += [(name, whole), *((name, whole[: whole.index(c)]) for c in CLOSINGS if c in whole)]
    return list(dict.fromkeys(out))


def canonical(text: Column) -> Column:
    """The form of a text that licence matching compares."""
    for char in FOLDING:
        text = F.replace(text, F.lit(char), F.lit(" "))
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), f"(?md){COPYRIGHT_LINE}", ""), "[^a-z0-9]+", " "))
    for spelling, standard in EQUIVALENT.items():
        plain = F.replace(plain, F.lit(spelling), F.lit(standard))
    return plain


def digest(text: Column) -> Column:
    """MD5 of the canonical form; null if nothing is left of it."""
    made = F.array(F.md5(canonical(text).cast("binary")))  # an array, so that the form is made only once
    return F.try_element_at(F.filter(made, lambda x: x != F.md5(F.lit("").cast("binary"))), F.lit(1))


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row per digest of the known texts: digest, license_id. As small as the list it is built from."""
    table = spark.createDataFrame(known_texts() if known is None else known, "license_id string, text string")
    return table.select(digest(F.col("text")).alias("digest"), "license_id").where("digest is not null").groupBy("digest").agg(F.min("license_id").alias("license_id"))


def sign_words(texts: list[str]) -> list[str]:
    """Words of which every text that equals one of these in canonical form holds at least one, as it is but for ASCII case.

    A word that an equivalent spelling could have made or changed is no sign. Chosen greedily, the longer of
    equals; words of SIGN_LENGTH letters or more where a text has some, as short ones are in most lines.
    """
    touched = " ".join([*EQUIVALENT, *EQUIVALENT.values()])
    words = [{w for w in re.findall("[a-z0-9]+", t.lower()) if w not in touched and not any(p in w for p in touched.split())} for t in texts]
    signs, left = [], [{w for w in own if len(w) >= SIGN_LENGTH} or own for own in words if own]
    while left:
        counts = Counter(w for own in left for w in own)
        best = max(counts, key=lambda w: (counts[w], len(w), w))
        signs.append(best)
        left = [own for own in left if best not in own]
    return signs


def scan_licenses(docs: DataFrame, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """Per row: doc_id, digest of the whole text, license_id of the whole text, line_licenses (sorted, comma-separated).

    Null and empty texts, and those with nothing but copyright lines, have no digest and no licence. Repeated
    rows and null ids are scanned row by row; texts of any length are one value; other columns of docs are not
    looked at, whatever their names; an empty table gives no rows.
    """
    known = known_texts() if known is None else known
    table = known_digests(docs.sparkSession, known)
    names = {r["digest"]: r["license_id"] for r in table.collect()}
    by_digest = F.create_map(*[F.lit(x) for pair in sorted(names.items()) for x in pair])
    signs = sign_words([t for _, t in known])

    def signed(text: Column) -> Column:
        low = F.lower(text)
        return F.array_contains(F.array(*[F.contains(low, F.lit(w)) for w in signs]), True)

    lines = F.filter(F.split("text", "\n"), lambda x: (x != "") & signed(x))
    found = F.array_intersect(F.transform(lines, digest), F.array(*map(F.lit, sorted(names))))
    line_licenses = F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda d: by_digest[d]))), ",")
    scanned = docs.select("doc_id", digest(F.col("text")).alias("digest"), F.coalesce(F.when(signed(F.col("text")), line_licenses), F.lit("")).alias("line_licenses"))
    return scanned.join(F.broadcast(table), "digest", "left").select("doc_id", "digest", "license_id", "line_licenses")


def scan_sql(known: list[tuple[str, str]] | None = None) -> str:
    """The same scan in DuckDB SQL."""
    known = known_texts() if known is None else known

    def quoted(value: str) -> str:
        return "'" + value.replace("'", "''") + "'"

    def form(text: str) -> str:
        low = f"translate({text}, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
        plain = f"trim(regexp_replace(regexp_replace({low}, {quoted('(?m)' + COPYRIGHT_LINE)}, '', 'g'), '[^a-z0-9]+', ' ', 'g'))"
        for spelling, standard in EQUIVALENT.items():
            plain = f"replace({plain}, {quoted(spelling)}, {quoted(standard)})"
        return f"nullif({plain}, '')"

    values = ", ".join(f"({quoted(i)}, {quoted(t)})" for i, t in known)
    return f"""with k as (select md5({form("t")}) as digest, min(i) as license_id from (values {values}) v(i, t) group by 1),
        w as (select doc_id, md5({form("text")}) as digest, row_number() over () as n, text from documents),
        l as (select n, md5({form("line")}) as d from (select n, unnest(string_split(text, chr(10))) as line from w) where length(line) > 0),
        f as (select l.n, string_agg(distinct k.license_id, ',' order by k.license_id) as line_licenses from l join k on l.d = k.digest group by l.n)
        select w.doc_id, w.digest, k.license_id, coalesce(f.line_licenses, '') as line_licenses
        from w left join k using (digest) left join f using (n)"""
