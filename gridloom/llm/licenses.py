"""License scans by diagonal voting.

Templates are word sequences of public license notices. All rolling word k-gram hashes of every
document are joined with the template positions; a hit at document word ``pos`` and template word
``tpos`` votes for the diagonal ``pos - tpos``. Votes are summed by diagonal, and every diagonal is
merged with its neighbours on either side (an inserted or dropped word moves the rest of a notice
by one): up to ``DIAGONAL_GAP`` of them, and one more for every ``DRIFT`` words of the template. A
merged band never grows beyond that, so stray votes can't chain notices together, and its span is
no longer than the template and twice the reach. The span of a band is verified: the distinct
template k-grams inside it must cover a share of the template. Of bands that overlap, the one that
covers most is kept (ties: the first).

The template book is fixed by the code (a few hundred rows), so broadcasting it is safe at any
input size. The pass over texts is one narrow stage; only hits and one end row per document go on.

Results for odd input: null, empty or wordless text has zero counts, null places, empty label
strings and score 0; very long texts are read whole; repeated rows and repeated or null ids are
separate rows; extra columns, whatever their names, are left out; an empty table gives an empty
result.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, word_positions

K = 3
#: Diagonals merged on either side, and words of a template for one more.
DIAGONAL_GAP, DRIFT = 3, 16
#: Share of a template's k-grams that a verified span must hold.
MIN_COVER = 0.6

#: Fixed values of the contract: phrases counted at every place, with their labels.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS "
    "OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_WARRANTY = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)

#: Public license notices and whole licenses, as written by their stewards.
TEMPLATES = [
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _WARRANTY,
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
        "promote products derived from this software without specific prior written permission. " + _BSD_WARRANTY,
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "
        "\"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
        "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL "
        "DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
        "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable "
        "for any damages arising from the use of this software. Permission is granted to anyone to use this software for any "
        "purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following "
        "restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original "
        "software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but "
        "is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the "
        "original software. 3. This notice may not be removed or altered from any source distribution.",
    ),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
        "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
        "commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of "
        "this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for "
        "the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an "
        "overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. " + _WARRANTY,
    ),
    (
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable "
        "law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
        "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License.",
    ),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
        "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. "
        "You should have received a copy of the GNU General Public License along with this program.",
    ),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    (
        "apache-2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
    ),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation",
    ),
    (
        "lgpl",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation",
    ),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies",
    ),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related rights to this work"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]


def template_words(text: str) -> list[str]:
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower()) if w]


def book(spark: SparkSession, templates=None) -> DataFrame:
    """Template positions: ``tid, label, words, tpos, s0, s1, s2``."""
    rows = []
    for tid, (label, text) in enumerate(TEMPLATES if templates is None else templates):
        w = template_words(text)
        rows += [(tid, label, len(w), p, *w[p : p + K]) for p in range(len(w) - K + 1)]
    return spark.createDataFrame(rows, "tid int, label string, words int, tpos long, s0 string, s1 string, s2 string")


def phrase_book(spark: SparkSession) -> DataFrame:
    rows = [(label, len(p.split()), *(p.split() + [None])[:K]) for p, label in PHRASES.items()]
    return spark.createDataFrame(rows, "plabel string, pn int, p0 string, p1 string, p2 string")


def scan(docs: DataFrame, id_col="doc_id", text_col="text", templates=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ends, base, spans): the end rows, places of base phrases, and verified license spans.

    spans: ``rid, label, tid, first, last, cover`` (word places, inclusive; cover: 0 to 1).
    """
    spark = docs.sparkSession
    templates = book(spark, templates)
    grams = templates.select("s0", "s1", "s2").distinct().withColumn("sid", F.xxhash64("s0", "s1", "s2"))
    phrases = phrase_book(spark)
    at = word_positions(docs, id_col, text_col).withColumn("h", F.xxhash64("w0", "w1", "w2"))
    gram = F.broadcast(grams)
    phrase = F.broadcast(phrases)
    found = (
        at.join(gram, (F.col("h") == F.col("sid")) & (F.col("w0") == F.col("s0")) & (F.col("w1") == F.col("s1")) & (F.col("w2") == F.col("s2")), "left")
        .join(phrase, (F.col("w0") == F.col("p0")) & (F.col("w1") == F.col("p1")) & (F.col("p2").isNull() | (F.col("w2") == F.col("p2"))), "left")
        .where(F.col("sid").isNotNull() | F.col("plabel").isNotNull() | (F.col("pos") == F.col("n_words")))
        .select("rid", "doc_id", "n_words", "pos", "sid", "plabel")
    )
    found = materialize(found, "license-places")
    ends = found.where(F.col("pos") == F.col("n_words")).select("rid", "doc_id", "n_words")
    base = found.where(F.col("plabel").isNotNull()).select("rid", "pos", F.col("plabel").alias("label"))

    lookup = templates.withColumn("sid", F.xxhash64("s0", "s1", "s2")).select("sid", "tid", "tpos")
    about = templates.groupBy("tid").agg(F.first("label").alias("label"), F.first("words").alias("words"))
    votes = found.where(F.col("sid").isNotNull()).select("rid", "pos", "sid").join(F.broadcast(lookup), "sid").withColumn("diag", F.col("pos") - F.col("tpos"))
    diagonals = votes.groupBy("rid", "tid", "diag").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.collect_set("tpos").alias("grams")).join(F.broadcast(about), "tid")
    diagonals = diagonals.withColumn("reach", F.lit(DIAGONAL_GAP) + F.floor(F.col("words") / DRIFT))
    # every neighbour of a diagonal votes for the bands it lies in, and says which one is its own
    bands = diagonals.withColumn("band", F.explode(F.sequence(F.col("diag") - F.col("reach"), F.col("diag") + F.col("reach"))))
    merged = (
        bands.groupBy("rid", "tid", "band")
        .agg(
            F.min("lo").alias("first"), (F.max("hi") + K - 1).alias("last"), F.size(F.array_distinct(F.flatten(F.collect_list("grams")))).alias("held"),
            F.max(F.col("band") == F.col("diag")).alias("voted"), F.max("words").alias("words"), F.max("label").alias("label"),
        )
        .where("voted")
        .withColumn("cover", F.col("held") / (F.col("words") - K + 1))
        .where(F.col("cover") >= MIN_COVER)
    )
    # a band within another's span gives way to the one that covers more
    near = Window.partitionBy("rid", "tid").orderBy("band").rangeBetween(-DIAGONAL_GAP, DIAGONAL_GAP)
    spans = merged.withColumn("best", F.max(F.struct("cover", (-F.col("band")).alias("at"))).over(near)).where(F.col("best")["at"] == -F.col("band")).select("rid", "label", "tid", "first", "last", "cover")
    return ends, base, spans


def licenses(docs: DataFrame, id_col="doc_id", text_col="text", templates=None) -> DataFrame:
    """Per document: counts and places of base phrases, labels of both kinds, and a score."""
    ends, base, spans = scan(docs, id_col, text_col, templates)
    both = base.select("rid", "pos", F.col("label").alias("base"), F.lit(None).cast("string").alias("span"), F.lit(1.0).alias("cover")).unionByName(
        spans.select("rid", F.lit(None).cast("long").alias("pos"), F.lit(None).cast("string").alias("base"), F.col("label").alias("span"), "cover")
    )
    per = both.groupBy("rid").agg(
        F.count("pos").alias("n_base"), F.min("pos").alias("first_word"), F.max("pos").alias("last_word"),
        F.collect_set("base").alias("b"), F.collect_set("span").alias("s"), F.max("cover").alias("score"),
    )
    empty = F.array().cast("array<string>")
    joined = lambda c: F.array_join(F.array_sort(c), ",")
    return ends.join(per, "rid", "left").select(
        "rid",
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"),
        "first_word",
        "last_word",
        joined(F.coalesce("b", empty)).alias("base_labels"),
        joined(F.array_union(F.coalesce("b", empty), F.coalesce("s", empty))).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
