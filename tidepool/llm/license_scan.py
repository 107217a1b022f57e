"""License scans: MinHash bands over overlapping windows, then exact containment.

Words are runs of a-z and 0-9 of the lower-cased text, shingles have five words. A template is a piece of the
smallest of SIZES that holds it, or is cut into pieces of the largest. For each size the text is read in windows
of twice that size at steps of the size, so a copy of a piece lies whole in some window.

Windows of the largest size, in which whole license texts are found, are retrieved by bands of two rows. Each shingle is
hashed once. A band's rows are the two least hashes of one of BINS ranges of the hash values, and families are rotations
of the hash, so all windows and bands reuse the shingles' hashes: a window is sorted once a family. A window that holds
80 % of a full piece has a Jaccard similarity of 0.35 or more with it, and FAMILIES * BINS bands then miss it with a chance
under MISS. A piece that the bands could miss more often (statements of a few dozen words, tails of texts) is
retrieved through windows of a single shingle, whose least hash is the shingle's: 80 % of n shingles hold one of
any n // 5 + 1, so these pieces are never missed.

What the bands retrieve is read again, and counts only if the window holds 80 % of the piece's shingles exactly, as words.
All of it is DataFrame expressions. The templates' tables are broadcast up to BROADCAST_ROWS rows and shuffled beyond;
retrieved windows likewise.

Defined results: null, empty or short text matches nothing; repeated rows match each; a document has a row for each
license that it matches; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

SHINGLE = 5
SIZES = (8, 32, 64)
FAMILIES = 2
BINS = 32
CONTAINMENT = 0.8
#: Largest chance that the bands alone may miss a piece in a window.
MISS = 1e-3
#: Rows of the templates' tables, and of retrieved windows, that are broadcast at most.
BROADCAST_ROWS = 200_000

#: Public license statements.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0-header", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("mit", "Released under the MIT License."),
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("bsd-redistribution", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("isc-text", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("bsd-2-text", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("lgpl-notice", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."),
    ("mpl-2.0-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("apache-2.0-notice", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
)


def let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), "")


def shingles(w: Column) -> Column:
    """Shingles of an array of words (a bound value)."""
    starts = F.when(F.size(w) >= SHINGLE, F.sequence(F.lit(0), F.size(w) - SHINGLE)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.concat_ws(" ", *[F.get(w, i + k) for k in range(SHINGLE)]))


def hashes(w: Column) -> Column:
    """A hash of each shingle of an array of words: the words' hashes are taken once."""

    def of(h: Column) -> Column:
        starts = F.when(F.size(h) >= SHINGLE, F.sequence(F.lit(0), F.size(h) - SHINGLE)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(SHINGLE)]))

    return let(F.transform(w, lambda x: F.xxhash64(x)), of)


def rotated(h: Column, family: int) -> Column:
    """The family's order of hashes (an array): a rotation by equal parts of their 64 bits."""
    by = 64 // FAMILIES * family
    return h if not by else F.transform(h, lambda x: F.shiftleft(x, by).bitwiseOR(F.shiftrightunsigned(x, 64 - by)))


def bands(h: Column, family: int) -> Column:
    """A hash over the two least values of h in each range that holds two or more."""
    apart = lambda x, y: F.shiftrightunsigned(x.bitwiseXOR(y), 64 - (BINS.bit_length() - 1)) != 0
    first = lambda s, x, i: (i == 0) | apart(x, F.get(s, i - 1))
    key = lambda s, x, i: F.when(first(s, x, i) & ~apart(x, F.get(s, i + 1)), F.xxhash64(F.lit(family), x, F.get(s, i + 1)))
    return let(F.sort_array(h), lambda s: F.filter(F.transform(s, lambda x, i: key(s, x, i)), lambda k: k.isNotNull()))


def banded(h: Column, family: int) -> Column:
    """(at, key) of the windows of the largest size over a text's hashes in the family's order (a bound value)."""
    size = max(SIZES)
    starts = F.when(F.size(h) > 0, F.sequence(F.lit(0), F.size(h) - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
    keys = lambda i: bands(F.slice(h, i + 1, 2 * size - SHINGLE + 1), family)
    return F.flatten(F.transform(starts, lambda i: F.transform(keys(i), lambda k: F.struct(i.alias("at"), k.alias("key")))))


def text_keys(h: Column) -> Column:
    """(at, key) of all windows of a text's hashes (a bound value): single shingles and bands."""
    single = F.transform(h, lambda x, i: F.struct(i.alias("at"), x.alias("key")))
    family = lambda f: let(rotated(h, f), lambda r: banded(r, f))
    return F.concat(single, *[family(f) for f in range(FAMILIES)])


def miss(n: Column) -> Column:
    """Chance that the bands miss a window of the largest size that holds 80 % of a piece of n shingles."""
    lacks = F.floor(n * (1 - CONTAINMENT) + 1e-9)
    held, union = n - lacks, 2 * max(SIZES) - SHINGLE + 1 + lacks
    none = F.pow(F.lit(1 - 1 / BINS), union)
    two = 1 - none * (1 + union / (BINS - 1))
    return F.pow(1 - held / union * (held - 1) / (union - 1) * two, F.lit(FAMILIES * BINS))


def piece_keys(own: Column, size: Column) -> Column:
    """(single, key) by which a piece is retrieved; own: its distinct shingles' hashes (a bound value)."""
    lacks = F.floor(F.size(own) * (1 - CONTAINMENT) + 1e-9).cast("int")
    sure = F.transform(F.slice(own, 1, lacks + 1), lambda k: F.struct(F.lit(True).alias("single"), k.alias("key")))
    family = lambda f: F.transform(let(rotated(own, f), lambda r: bands(r, f)), lambda k: F.struct(F.lit(False).alias("single"), k.alias("key")))
    whole = F.flatten(F.array(*[family(f) for f in range(FAMILIES)]))
    return F.when((size < max(SIZES)) | (miss(F.size(own)) > MISS), sure).otherwise(whole)


def few(df: DataFrame) -> DataFrame:
    """df, with a broadcast hint if it has at most BROADCAST_ROWS rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def pieces(templates: DataFrame) -> DataFrame:
    """(license, piece, size, shingles) of templates (license, text): pieces of the
    largest size, or of the smallest size that holds a shorter template."""
    cut = templates.select("license", words(F.col("text")).alias("w"))
    largest = max(SIZES)
    size = F.lit(largest)
    for n in sorted(SIZES, reverse=True):
        size = F.when(F.size("w") <= n, F.lit(n)).otherwise(size)
    cut = cut.where(F.size("w") >= SHINGLE).withColumn("size", size)
    # a last piece too short for a shingle would add nothing
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - SHINGLE, F.lit(0)), F.lit(largest))
    rows = cut.select("license", "size", "w", F.posexplode(starts).alias("piece", "start")).withColumn("w", F.slice("w", F.col("start") + 1, largest))
    return rows.select("license", "piece", "size", let(F.col("w"), shingles).alias("need"), F.array_distinct(hashes(F.col("w"))).alias("hashes"))


def retrieved(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(id, mark, license, piece, size, start) of windows of docs (id, mark, text) that share a key with a piece."""
    table = known.select("license", "piece", "size", F.inline(let(F.col("hashes"), lambda h: piece_keys(h, F.col("size")))))
    keys = docs.select("id", "mark", F.inline(let(hashes(words(F.col("text"))), text_keys)))
    met = keys.join(few(table), "key")
    # a single shingle lies in two windows of its piece's size; a band names its window
    of_size = F.col("at") - F.col("at") % F.col("size")
    starts = F.when(F.col("single"), F.array(of_size, of_size - F.col("size"))).otherwise(F.array("at"))
    rows = met.select("id", "mark", "license", "piece", "size", F.explode(starts).alias("start"))
    return rows.where("start >= 0").distinct()


def scan(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """doc_id, license, n_windows and best_containment of each match."""
    known = materialize(pieces(templates), "license-pieces")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("mark"), "text")
    found = materialize(retrieved(texts, known), "license-windows")
    same = F.col("id").eqNullSafe(F.col("own_id")) & (F.col("mark") == F.col("own_mark"))
    again = texts.select(F.monotonically_increasing_id().alias("row"), F.col("id").alias("own_id"), F.col("mark").alias("own_mark"), "text").join(few(found), same)
    cut = again.select("row", "own_id", "license", "piece", let(F.slice(words(F.col("text")), F.col("start") + 1, 2 * F.col("size")), shingles).alias("have"))
    share = F.size(F.array_intersect("have", "need")) / F.size(F.array_distinct("need"))
    held = cut.join(few(known.select("license", "piece", "need")), ["license", "piece"]).select("row", "own_id", "license", "piece", share.alias("share")).where(F.col("share") >= CONTAINMENT)
    by_piece = held.groupBy("row", "own_id", "license", "piece").agg(F.count("*").alias("n"), F.max("share").alias("share"))
    total = known.groupBy("license").agg(F.count("*").alias("pieces"))
    matched = by_piece.groupBy("row", "own_id", "license").agg(F.count("*").alias("pieces_found"), F.sum("n").alias("n_windows"), F.avg("share").alias("best_containment"))
    return matched.join(few(total), "license").where(F.col("pieces_found") >= CONTAINMENT * F.col("pieces")).select(F.col("own_id").alias("doc_id"), "license", "n_windows", "best_containment")


def default_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TEMPLATES), "license string, text string")


def oracle_sql() -> str:
    """Exact containment of every window, without bands. Documents that share no shingle with any template
    can't match and are left out, as there are many."""
    values = ", ".join(f"""('{n}', '{t.replace("'", "''")}')""" for n, t in TEMPLATES)
    largest = max(SIZES)
    case = " ".join(f"WHEN len(w) <= {n} THEN {n}" for n in sorted(SIZES))
    cut = "list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '')"
    grams = "list_transform(generate_series(1, len({0}) - 4), lambda i: array_to_string(list_slice({0}, i, i + 4), ' '))"
    return f"""
    WITH t AS (SELECT license, {cut} AS w FROM (VALUES {values}) v(license, text)),
    p AS (SELECT license, CASE {case} ELSE {largest} END AS size, list_slice(w, s + 1, s + {largest}) AS w, s
          FROM t, unnest(generate_series(0, greatest(len(w) - 5, 0), {largest})) u(s) WHERE len(w) >= 5),
    need AS (SELECT license, size, s, list_distinct({grams.format("w")}) AS need FROM p),
    d AS (SELECT doc_id, w FROM (SELECT doc_id, {cut} AS w FROM documents) WHERE len(w) >= 5 AND list_has_any({grams.format("w")}, (SELECT list(DISTINCT g) FROM need, unnest(need) x(g)))),
    win AS (SELECT doc_id, size, list_slice(w, s + 1, s + 2 * size) AS w
            FROM d, (VALUES {", ".join(f"({n})" for n in SIZES)}) z(size), unnest(generate_series(0, len(w) - 1, size)) u(s)),
    have AS (SELECT doc_id, size, {grams.format("w")} AS have FROM win WHERE len(w) >= 5),
    hit AS (SELECT doc_id, license, s, len(list_intersect(have, need)) / len(need) AS share FROM have JOIN need USING (size)),
    by_piece AS (SELECT doc_id, license, s, count(*) AS n, max(share) AS share FROM hit WHERE share >= {CONTAINMENT} GROUP BY ALL)
    SELECT doc_id, license, CAST(sum(n) AS BIGINT) AS n_windows, avg(share) AS best_containment
    FROM by_piece JOIN (SELECT license, count(*) AS pieces FROM need GROUP BY license) USING (license)
    GROUP BY doc_id, license, pieces HAVING count(*) >= {CONTAINMENT} * pieces
    """
