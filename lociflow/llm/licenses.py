"""License scan: MinHash bands over overlapping text windows find templates, exact shingle containment confirms them.

Windows of WINDOW shingles (of five words) begin every WINDOW / 2 shingles, so they overlap by half; all windows of all texts are
signed. A window's shingles fall into BINS bins by hash, and each bin's least value is a band of one row (one permutation). A template of
LONG shingles or more is read in pieces of one shingle, so a window meets it in a band as soon as it holds one of its shingles that is the
least of its bin. Of 16 shingles in 8 bins one is with a chance of 0.44, and in one of its two windows with 0.62, wherever it stands; a
text with three quarters of a template's n shingles misses all bands with a chance of about 0.38^(0.75 n): 1e-5 at n = 16, 1e-7 at 22,
under 1e-12 at 40. Shorter templates (down to a single shingle, of which nothing can be left out) have windows of one shingle, so none is missed.

What is found is a text and a template; then the text's whole set of shingles is compared with the template's as strings, so the
containment is exact and counts if it is at least `percent`.

Words are runs of ASCII letters and digits and of all characters beyond ASCII, lower-cased. Null and short texts hold no
template; texts of any length are read whole. A text gives one row per template, repeated rows one each; ties can't arise. Empty
tables give empty results. Input columns but id and text aren't read, so their names don't matter; the id column comes back under its
own name, or with `_in` behind it where a new column has that name. Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH, PERCENT = 5, 75
WINDOW, BINS, LONG = 16, 8, 16
#: Columns of the result beside the id.
NEW = ("license_id", "n_shingles", "n_matched", "containment")
#: Templates up to so many characters in all are broadcast, and joined by a shuffle beyond.
FEW_CHARACTERS = 4_000_000
_GAP = r"[^a-z0-9\x{80}-\x{10FFFF}]+"

_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS
BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution. """
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT
NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING,
BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED
AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT
OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

#: The words by which texts state their licence, and whole licence texts.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MIT-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software. """ + _WARRANTY,
    "BSD-2-Clause-text": _BSD + _BSD_END,
    "BSD-3-Clause-text": _BSD + """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission. """ + _BSD_END,
    "ISC-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS
ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE
LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
SOFTWARE.""",
    "zlib-text": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial
applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be
misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the
product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be
misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
}


def _words(text: Column) -> Column:
    return F.split(F.lower(F.coalesce(text, F.lit(""))), _GAP)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, wherever the optimizer moves the whole."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _places(words: Column) -> Column:
    """The places where a shingle begins."""
    return F.when(F.size(words) >= WIDTH, F.sequence(F.lit(0), F.size(words) - WIDTH)).otherwise(F.array().cast("array<int>"))


def _hashes(words: Column) -> Column:
    return F.transform(_places(words), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WIDTH)]))


def _shingle(words: Column, at: Column) -> Column:
    return F.array_join(F.slice(words, at + 1, F.lit(WIDTH)), " ")


def _least(values: Column) -> Column:
    """The least value of each bin, which is a value's top bits."""
    bin_of = lambda v: F.shiftrightunsigned(v, 64 - (BINS - 1).bit_length())
    return _let(F.sort_array(values), lambda o: F.filter(o, lambda v, i: (i == 0) | (bin_of(v) != bin_of(F.get(o, i - 1)))))


def _short(h: Column) -> Column:
    """A band of templates under LONG shingles: odd."""
    return h.bitwiseOR(F.lit(1))


def _long(h: Column) -> Column:
    """A band of the other templates: even."""
    return h.bitwiseAND(F.lit(-2))


def _bands(words: Column) -> Column:
    """All bands of a text."""
    half = WINDOW // 2

    def signed(hashes: Column) -> Column:
        last = F.greatest(F.lit(0), F.ceil(F.size(hashes) / F.lit(half)).cast("int") - 2)
        begins = F.when(F.size(hashes) > 0, F.transform(F.sequence(F.lit(0), last), lambda j: j * half)).otherwise(F.array().cast("array<int>"))
        least = F.flatten(F.transform(begins, lambda j: _least(F.slice(hashes, j + 1, F.lit(WINDOW)))))
        return F.concat(F.transform(hashes, _short), F.transform(least, _long))

    return _let(_hashes(words), signed)


def _table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """(license_id, n, s, h): a row for each distinct shingle of a template; n of them in all."""
    table = spark.createDataFrame([(k, v) for k, v in templates.items()], "license_id string, text string")
    words = F.filter(_words(F.col("text")), lambda w: w != "")
    table = table.select("license_id", words.alias("w")).select("license_id", F.arrays_zip(F.transform(_places(F.col("w")), lambda i: _shingle(F.col("w"), i)).alias("s"), _hashes(F.col("w")).alias("h")).alias("all"))
    return table.select("license_id", F.size(F.array_distinct("all")).alias("n"), F.explode(F.array_distinct("all")).alias("x")).select("license_id", "n", "x.s", "x.h")


def _places_of(band: Column, size: int) -> list[Column]:
    """Two of 2^size bits for a band."""
    return [F.shiftrightunsigned(band, 1 + k * size).bitwiseAND(F.lit((1 << size) - 1)) for k in range(2)]


def _marks(bands: DataFrame, size: int) -> DataFrame:
    """One row: 2^size bits in long integers, two set for each band, so that a text can leave out bands of no template before it makes rows of them."""
    at = bands.select(F.explode(F.array(*_places_of(F.col("band"), size))).alias("at"))
    words = at.select(F.shiftright("at", 6).alias("i"), F.expr("shiftleft(1L, CAST(at & 63 AS INT))").alias("bit")).groupBy("i").agg(F.bit_or("bit").alias("bits"))
    words = bands.sparkSession.range(1 << (size - 6)).select(F.col("id").alias("i")).join(words, "i", "left")
    return words.agg(F.transform(F.sort_array(F.collect_list(F.struct("i", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")))), lambda x: x["bits"]).alias("marks"))


def _marked(bands: Column, marks: Column, size: int) -> Column:
    """The bands that may be a template's, each once."""
    known = lambda at: F.getbit(F.get(marks, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")) == 1
    both = lambda b: known(_places_of(b, size)[0]) & known(_places_of(b, size)[1])
    return F.array_distinct(F.filter(bands, both))


def _candidates(texts: DataFrame, bands: DataFrame, characters: int) -> DataFrame:
    """(row, id, words, licenses) of texts that meet a template in a band; characters: of all templates.

    Up to FEW_CHARACTERS the bands are broadcast, and a set of bits (at least 16 a character) leaves out other bands first: a text makes at most a
    row for each distinct band of the templates, in its own task, and only texts that meet a template are sent on, once each.
    Otherwise bands are joined without the texts, which are then met again by id; equal ids share their candidates.
    explode_outer, here and below: for explode the optimizer would add a filter that makes the same arrays again.
    """
    if characters <= FEW_CHARACTERS:
        size = max(20, (16 * characters).bit_length())
        marked = texts.withColumn("marks", _marks(bands, size).scalar()).withColumn("bands", _marked(_bands(F.col("words")), F.col("marks"), size))
        met = marked.select("row", "id", "words", F.explode_outer("bands").alias("band")).join(F.broadcast(bands), "band")
        return met.groupBy("row").agg(F.first("id").alias("id"), F.first("words").alias("words"), F.collect_set("license_id").alias("licenses"))
    met = texts.select("id", F.explode_outer(F.array_distinct(_bands(F.col("words")))).alias("band")).join(bands, "band")
    met = met.groupBy(F.col("id").alias("__id")).agg(F.collect_set("license_id").alias("licenses"))
    return texts.join(met, F.col("id").eqNullSafe(F.col("__id"))).drop("__id")


def scan(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", templates: dict[str, str] | None = None, percent: int = PERCENT) -> DataFrame:
    """(id, license_id, n_shingles of the template, n_matched, containment) of each template that a text holds."""
    templates = TEMPLATES if templates is None else templates
    characters = sum(map(len, templates.values()))
    few = F.broadcast if characters <= FEW_CHARACTERS else lambda table: table
    table = _table(df.sparkSession, templates)
    bands = table.select(F.when(F.col("n") < LONG, _short(F.col("h"))).otherwise(_long(F.col("h"))).alias("band"), "license_id").distinct()
    texts = df.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"), _words(F.col(f"`{text_col}`")).alias("words"))
    found = _candidates(texts, bands, characters).select("row", "id", "words", F.explode("licenses").alias("license_id"))
    shingles = found.select("row", "id", "license_id", F.explode_outer(F.array_distinct(F.transform(_places(F.col("words")), lambda i: _shingle(F.col("words"), i)))).alias("s"))
    counted = shingles.join(few(table.select("license_id", "n", "s")), ["license_id", "s"]).groupBy("row", "id", "license_id", "n").agg(F.count(F.lit(1)).alias("m")).where(100 * F.col("m") >= percent * F.col("n"))
    out = f"{id_col}_in" if id_col.lower() in NEW else id_col
    return counted.select(F.col("id").alias(out), "license_id", F.col("n").cast("long").alias("n_shingles"), F.col("m").alias("n_matched"), (F.col("m") / F.col("n")).alias("containment"))
