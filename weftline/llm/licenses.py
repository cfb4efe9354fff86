"""Licence scans: canonical texts are hashed and looked up among the digests of known licences. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lines that only name a copyright holder: they differ between copies of one licence.
COPYRIGHT_LINE = r"(?m)^[^\p{L}\n]*(copyright|\(c\)|©)[^\n]*$"
#: Whatever isn't a letter or digit.
PUNCTUATION = r"[^\p{L}\p{N}]+"
#: Equivalent spellings, replaced in this order in lower-case text; both sides are treated alike, so only equality matters.
SPELLINGS = (
    ("https", "http"),
    ("licence", "license"),
    ("isation", "ization"),
    ("ise ", "ize "),
    ("ised ", "ized "),
    ("ising ", "izing "),
    ("judgement", "judgment"),
    ("acknowledgement", "acknowledgment"),
    ("favour", "favor"),
    ("honour", "honor"),
    ("fulfil ", "fulfill "),
    ("wilful", "willful"),
    ("programme", "program"),
    ("catalogue", "catalog"),
    ("sub license", "sublicense"),
    ("non infringement", "noninfringement"),
    ("non commercial", "noncommercial"),
    ("merchantibility", "merchantability"),
    ("copyright owner", "copyright holder"),
    ("per cent", "percent"),
)

_NO_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES '
    "OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE "
    "LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
    "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_AUTHOR_DISCLAIMS = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
    "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
    "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
    "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_CONDITIONS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
    "are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
    "disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
    "disclaimer in the documentation and/or other materials provided with the distribution.\n\n"
)
_BSD_NAMES = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
    "this software without specific prior written permission.\n\n"
)
_BSD_DISCLAIMER = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
    "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
    "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
    "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
#: Known texts: (licence id, "text" for a whole licence or "notice" for a short statement, text). A caller may pass a larger table.
KNOWN = (
    (
        "MIT",
        "text",
        "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to '
        "use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice "
        "shall be included in all copies or substantial portions of the Software.\n\n" + _NO_WARRANTY,
    ),
    (
        "ISC",
        "text",
        "ISC License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _AUTHOR_DISCLAIMS,
    ),
    (
        "0BSD",
        "text",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _AUTHOR_DISCLAIMS,
    ),
    ("BSD-2-Clause", "text", _BSD_CONDITIONS + _BSD_DISCLAIMER),
    ("BSD-3-Clause", "text", _BSD_CONDITIONS + _BSD_NAMES + _BSD_DISCLAIMER),
    (
        "Zlib",
        "text",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
        "arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial "
        "applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must "
        "not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment "
        "in the product documentation would be appreciated but is not required.\n\n2. Altered source versions must be plainly marked as such, and "
        "must not be misrepresented as being the original software.\n\n3. This notice may not be removed or altered from any source distribution.",
    ),
    (
        "Unlicense",
        "text",
        "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any "
        "means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in "
        "the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and "
        "successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software "
        'under copyright law.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO '
        "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY "
        "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
        "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\nFor more information, please refer to <https://unlicense.org>",
    ),
    ("MIT", "notice", "Released under the MIT License."),
    ("MIT", "notice", "Licensed under the MIT License."),
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-only", "notice", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "notice", "Licensed under CC BY 4.0."),
    ("CC0-1.0", "notice", "Released under CC0 1.0."),
    ("Unlicense", "notice", "This is free and unencumbered software released into the public domain."),
)
#: Digests of the canonical whole texts of long licences, fixed values: made by ``digest`` from their published texts.
DIGESTS = (
    ("Apache-2.0", "50a67c5493f9b208301e6bfbf56baf320df006984130a1d98160a9b2fc3134e8"),
    ("Artistic-1.0-Perl", "114c2e4e4fbd1c4955c2a4d486fc8942d07a436202fe3982b9f9b979f340b586"),
    ("CC0-1.0", "16d362763ece5609ce42ddbd9b5b15990ea525462ee0b6908d7b2e568f9d773b"),
    ("GFDL-1.2", "21d29e421cec73adbb48be469840a9e859962acb6a71b6328093b98629fe564d"),
    ("GFDL-1.3", "6b0c1989683bf92cc2738f0aab4d0e5a427fbe886d3edafec7a87d4b3aa5181c"),
    ("GPL-1.0", "d056e17acf48fe33720cce879f060963abd6ffe700f8ef15bbaa5df4768a3895"),
    ("GPL-2.0", "f024174c25d889fb5806191eb5f3ff6198e8a1f3501425425597da4043602bf4"),
    ("GPL-3.0", "2997f383b4036df98b676dfca82c58b595b7c09a482a02685dd59d2d74ea7b93"),
    ("LGPL-2.0", "1aeff31101589a75dd5d44203c552b1ce6a0fa4d143cdf33f8e9490082a16945"),
    ("LGPL-2.1", "f22a8d6cd03a37361bd6ccb3b9315c52c508c0baa4534c90e1734864cb3c8035"),
    ("LGPL-3.0", "9111884d93a72b30a3d024876dab3d755949ac2cfab230268a4169a93b86560c"),
    ("MPL-1.1", "cfdcc584cd692ae8084d86e455baac90cad88a7c91fcd2c7e479590854ba8f21"),
    ("MPL-2.0", "88b06c62211af6dc8c37d9eece56c91b643d4359669fbd9f658f1945205c47bb"),
)


def canonical(text: Column) -> Column:
    """Lower case, no copyright lines, one space for each run of punctuation and white space, one spelling of each word."""
    out = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, " ")
    out = F.concat(F.lit(" "), F.regexp_replace(out, PUNCTUATION, " "), F.lit(" "))
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.trim(F.regexp_replace(out, " +", " "))


def digest(text: Column) -> Column:
    """SHA-256 of the canonical text; null where nothing is left of it."""
    return F.sha2(F.nullif(canonical(text), F.lit("")), 256)


def read_licenses(spark: SparkSession, path: str) -> DataFrame:
    """(license_id, kind, text) of a folder with a whole licence text in each file, named by its id."""
    return spark.read.text(path, wholetext=True).select(F.regexp_replace(F.col("_metadata.file_name"), r"\.(txt|md)$", "").alias("license_id"), F.lit("text").alias("kind"), F.col("value").alias("text"))


def known_licenses(spark: SparkSession, known=KNOWN, digests=DIGESTS, more: DataFrame | None = None) -> DataFrame:
    """(license_id, kind, digest, size), one row for each digest and kind; of equal digests the first id in order counts.

    ``more`` adds texts (license_id, kind, text), such as those of ``read_licenses``.
    """
    rows = spark.createDataFrame(list(known), "license_id string, kind string, text string")
    rows = rows if more is None else rows.union(more.select("license_id", "kind", "text"))
    rows = rows.select("license_id", "kind", digest(F.col("text")).alias("digest"), F.length(canonical(F.col("text"))).alias("size")).where("digest is not null")
    rows = rows.union(spark.createDataFrame([(i, "text", d, 0) for i, d in digests], rows.schema))
    return rows.groupBy("digest", "kind").agg(F.min("license_id").alias("license_id"), F.max("size").alias("size"))


def scan_licenses(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_broadcast: int = 100_000) -> DataFrame:
    """(id, digest, license_id, notices, n_notices) for every row.

    license_id is the known licence whose whole canonical text equals the row's whole
    canonical text, else null. Every line is looked up in the same way among the known
    notices; notices lists the distinct ids found, sorted and joined by a comma (empty
    if none), and n_notices counts the lines. The known table is broadcast only while
    it has at most ``max_broadcast`` digests; a larger one is joined by shuffle.

    Null, empty and punctuation-only texts have a null digest and match nothing; rows
    that repeat get a row each. Other columns are ignored; an empty table gives an empty
    result.
    """
    hint = F.broadcast if known.limit(max_broadcast + 1).count() <= max_broadcast else (lambda x: x)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    whole = hint(known.where("kind = 'text'").select("digest", "license_id"))
    # null texts have a key each, so that they don't meet in one task
    key = F.coalesce(F.sha2("text", 256), F.xxhash64("id").cast("string")).alias("key")
    out = own.select("id", key, digest(F.col("text")).alias("digest")).join(whole, "digest", "left")

    notices = hint(known.where("kind = 'notice'").select(F.col("digest").alias("line_digest"), F.col("license_id").alias("notice_id")))
    # spellings change a text's length by far less than a half, so longer lines are no notice
    longest = known.where("kind = 'notice'").agg(F.max("size")).first()[0] or 0
    lines = own.select(key, F.explode_outer(F.split("text", "\n")).alias("line"))
    lines = lines.where(F.length(F.regexp_replace("line", PUNCTUATION, " ")) <= 2 * longest + 16).select("key", digest(F.col("line")).alias("line_digest"))
    # copies of a text find the same notices: found once more for each copy, so counted per copy
    found = lines.join(notices, "line_digest").groupBy("key", "notice_id").agg(F.count("*").alias("n"))
    copies = own.where("text is not null").groupBy(key).agg(F.count("*").alias("copies"))
    found = found.groupBy("key").agg(F.array_join(F.sort_array(F.collect_set("notice_id")), ",").alias("notices"), F.sum("n").alias("n"))
    found = found.join(copies, "key").select("key", "notices", (F.col("n") / F.col("copies")).cast("long").alias("n_notices"))
    out = out.join(found, "key", "left")
    return out.select(F.col("id").alias(id_col), "digest", "license_id", F.coalesce("notices", F.lit("")).alias("notices"), F.coalesce("n_notices", F.lit(0)).alias("n_notices"))
