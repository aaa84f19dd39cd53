"""Licence notices and texts found by the Dice coefficient over word bigrams.

A text is cut into segments at line ends and sentence ends; units are runs of
consecutive segments, so a notice is found wrapped over lines, inside a longer
text or beside other sentences. Two bigram sets of a and b members can reach a
coefficient of t only if b is between a * t / (2 - t) and a * (2 - t) / t. The
lower bound says how many of a template's bigrams a text must hold at least,
and the upper one how far apart they may stand; both are tested before any run
is built. DataFrame functions throughout.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Whole licence texts without their copyright lines, as their publishers word them.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
BSD_TWO = """1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
BSD_THREE = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
BSD_TAIL = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSL = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

#: Licence notices as their publishers word them.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("MIT", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("MIT", MIT),
    ("ISC", ISC),
    ("BSD-2-Clause", BSD_HEAD + BSD_TWO + BSD_TAIL),
    ("BSD-3-Clause", BSD_HEAD + BSD_TWO + BSD_THREE + BSD_TAIL),
    ("Zlib", ZLIB),
    ("Unlicense", UNLICENSE),
    ("BSL-1.0", BSL),
]


SENTENCE_END = r"([.!?:;])[ \t]+"


def template_words(text: str) -> list[str]:
    return re.sub(r"[^a-z0-9]+", " ", text.lower()).split()


def template_bigrams(text: str) -> list[str]:
    w = template_words(text)
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:])})


def size_bounds(n: int, threshold: float) -> tuple[int, int]:
    """Sizes that a set can have to reach the threshold with one of n."""
    return math.ceil(n * threshold / (2 - threshold) - 1e-9), math.floor(n * (2 - threshold) / threshold + 1e-9)


def catalogue(templates: list[tuple[str, str]], threshold: float) -> list[dict]:
    """Each template's bigrams, `need`: how many of them a unit holds at least, and `limit`: the bigrams of a unit at most, repeats counted."""
    out = []
    for k, (license_id, text) in enumerate(templates):
        own = template_bigrams(text)
        if own:
            out.append({"k": k, "license": license_id, "bigrams": own, "need": size_bounds(len(own), threshold)[0], "limit": size_bounds(len(template_words(text)) - 1, threshold)[1]})
    return out


def marker_words(entries: list[dict]) -> list[str]:
    """Words of which every text that reaches the threshold with some template holds one.

    A unit lacks n - need of a template's bigrams at most, so the words of any
    more of them will do. Those that serve most templates come first, long ones before short ones.
    """
    lack = {t["k"]: len(t["bigrams"]) - t["need"] + 1 for t in entries}
    left = {t["k"]: set(t["bigrams"]) for t in entries}
    out: list[str] = []
    while any(n > 0 for n in lack.values()):
        gain: Counter = Counter()
        for k, bigrams in left.items():
            if lack[k] > 0:
                for w, n in Counter(w for b in bigrams for w in set(b.split())).items():
                    gain[w] += min(n, lack[k])
        word = max(gain, key=lambda w: (min(len(w), 7), gain[w], w))
        out.append(word)
        for k, bigrams in left.items():
            gone = {b for b in bigrams if word in b.split()}
            lack[k] -= len(gone)
            bigrams -= gone
    return out


def _words(x: Column) -> Column:
    return F.filter(F.split(F.lower(x), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once for each row, however often they are used: out of a generator."""
    for name, c in columns.items():
        df = df.select("*", F.explode(F.array(c)).alias(name))
    return df


def _runs() -> Column:
    """Of a row with words, segments, bigrams and a template t: the runs of segments that may reach the threshold, as (s, e).

    A run begins in the segment of some bigram of the template's and ends in that of another one, with `need` of them
    between, no farther apart than `limit`.
    """
    hit, segment = (lambda k: F.get("hits", k)), (lambda i: F.get("segment", i))
    last = F.size("hits") - 1
    begins = F.filter(F.sequence(F.lit(0), last + 1 - F.col("t.need")), lambda k: (hit(k + F.col("t.need") - 1) - hit(k) <= F.col("t.limit")) & ((k == 0) | (segment(hit(k - 1)) != segment(hit(k)))))

    def ends(k: Column) -> Column:
        near = F.sequence(k + F.col("t.need") - 1, F.least(last, k + F.col("t.limit")))
        near = F.filter(near, lambda j: (hit(j) - hit(k) <= F.col("t.limit")) & ((j == last) | (segment(hit(j + 1) + 1) != segment(hit(j) + 1))))
        return F.transform(near, lambda j: F.struct(segment(hit(k)).alias("s"), segment(hit(j) + 1).alias("e")))

    return F.flatten(F.transform(begins, ends))


def scan(docs: DataFrame, threshold: float = 0.8, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id, first_line, last_line (from 0), license, dice of each notice found.

    Units are runs of segments, which end at line ends and after one of .!?:; before a
    blank, with no more bigrams (repeats counted) than the upper size bound
    of the template's own number of words admits. Of units that overlap only the best
    stays: by coefficient, then by the
    template's size, then fewest segments, then the first, then the first template. Null and empty texts give no rows, a null doc_id stays null,
    repeated rows give repeated rows, other columns are ignored, texts of any
    length are read whole. Templates must be a fixed list, as they are sent to every task.
    """
    entries = catalogue(templates or TEMPLATES, threshold)
    listed = F.from_json(F.lit(json.dumps(entries)), "array<struct<k int, license string, bigrams array<string>, need int, limit int>>")
    some, every = (F.lit(x).cast("array<string>") for x in (marker_words(entries), sorted({b for t in entries for b in t["bigrams"]})))
    words = F.split(F.lower(F.col("text").cast("string")), r"[^\p{L}\p{N}]+")
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.arrays_overlap(words, some))
    segments = F.flatten(F.transform(F.split("text", "\n"), lambda line, i: F.transform(F.split(F.regexp_replace(line, SENTENCE_END, "$1\n"), "\n"), lambda s: F.struct(i.alias("line"), _words(s).alias("words")))))
    rows = _once(marked.select("doc_id", F.monotonically_increasing_id().alias("row"), "text"), segments=segments).drop("text")
    rows = rows.select("doc_id", "row", F.transform("segments", lambda x: x.line).alias("line"), F.flatten(F.transform("segments", lambda x: x.words)).alias("words"), F.flatten(F.transform("segments", lambda x, k: F.transform(x.words, lambda _: k))).alias("segment"))
    pair = F.zip_with(F.slice("words", F.lit(1), F.greatest(F.size("words") - 1, F.lit(0))), F.slice("words", F.lit(2), F.greatest(F.size("words") - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    rows = _once(rows, bigrams=pair)
    rows = _once(rows, held=F.array_intersect("bigrams", every)).where(F.size("held") >= min(t["need"] for t in entries))
    met = rows.select("*", F.explode(F.filter(listed, lambda t: F.size(F.array_intersect("held", t.bigrams)) >= t.need)).alias("t")).drop("held")
    met = _once(met, hits=F.filter(F.sequence(F.lit(0), F.size("bigrams") - 1), lambda i: F.array_contains("t.bigrams", F.get("bigrams", i))))
    met = _once(met, runs=_runs(), back=F.reverse("segment")).where(F.size("runs") > 0)

    def measured(r: Column) -> Column:
        first, after = F.array_position("segment", r.s).cast("int"), (F.size("words") + 1 - F.array_position("back", r.e)).cast("int")
        own = F.slice("bigrams", first, F.greatest(after - first, F.lit(0)))
        dice = 2 * F.size(F.array_intersect(own, F.col("t.bigrams"))) / (F.size(F.array_distinct(own)) + F.size("t.bigrams"))
        return F.struct((-dice).alias("rank"), (-F.size("t.bigrams")).alias("size"), (r.e - r.s).alias("more"), r.s.alias("s"), F.col("t.k").alias("k"), r.e.alias("e"), (after - first).alias("n"))

    found = met.select("doc_id", "row", "line", "t.license", "t.limit", F.explode(F.transform("runs", measured)).alias("unit")).where((F.col("unit.rank") <= -threshold) & (F.col("unit.n") <= F.col("limit")))
    found = found.select("doc_id", "row", "license", "unit", F.get("line", "unit.s").alias("first_line"), F.get("line", "unit.e").alias("last_line"))
    at = found.select("*", F.explode(F.sequence("unit.s", "unit.e")).alias("at"))
    # a unit stays if it is the best one at each of its segments
    best = at.groupBy("row", "at").agg(F.min_by(F.struct("doc_id", "license", "unit", "first_line", "last_line"), "unit").alias("b"))
    kept = best.groupBy("row", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == F.col("b.unit.more") + 1)
    return kept.select("b.doc_id", "b.first_line", "b.last_line", "b.license", F.round(-F.col("b.unit.rank"), 6).alias("dice"))


def scan_sql(threshold: float = 0.8) -> str:
    """The same result over `documents` in DuckDB's SQL: all runs between two bigrams of a template that a text holds."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({t['k']}, {quoted(t['license'])}, {t['need']}, {t['limit']}, [{', '.join(map(quoted, t['bigrams']))}])" for t in catalogue(TEMPLATES, threshold))
    return f"""
WITH t(k, license, need, lim, b) AS (VALUES {rows}),
l AS (SELECT row_number() OVER () AS r, doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL),
u AS (SELECT r, doc_id, unnest(range(len(a))) AS line, unnest(a) AS unit FROM l),
v AS (SELECT r, doc_id, line, string_split(regexp_replace(unit, '([.!?:;])[ \\t]+', '\\1' || chr(10), 'g'), chr(10)) AS a FROM u),
x AS (SELECT r, doc_id, line, unnest(range(len(a))) AS part, unnest(a) AS unit FROM v),
g AS (SELECT r, doc_id, line, row_number() OVER (PARTITION BY r ORDER BY line, part) - 1 AS seg,
  list_filter(string_split(regexp_replace(lower(unit), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda q: q <> '') AS w FROM x),
e AS (SELECT r, doc_id, line, seg, unnest(w) AS word, unnest(range(len(w))) AS i FROM g),
p AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY seg, i) AS pos FROM e),
n AS (SELECT *, word || ' ' || lead(word) OVER o AS bigram, lead(seg) OVER o AS seg2, lead(line) OVER o AS line2 FROM p WINDOW o AS (PARTITION BY r ORDER BY pos)),
tb AS (SELECT k, need, lim, unnest(b) AS bigram FROM t),
h AS (SELECT r, k, pos, seg, seg2, line, line2, lim, bigram FROM n JOIN tb USING (bigram)
  WHERE (r, k) IN (SELECT (r, k) FROM n JOIN tb USING (bigram) GROUP BY r, k, need HAVING count(DISTINCT bigram) >= need)),
runs AS (SELECT DISTINCT a.r, a.k, a.seg AS s, z.seg2 AS e, a.line AS first_line, z.line2 AS last_line FROM h a JOIN h z ON a.r = z.r AND a.k = z.k AND z.pos BETWEEN a.pos AND a.pos + a.lim),
d AS (SELECT runs.r, any_value(doc_id) AS doc_id, runs.k, s, runs.e, first_line, last_line, count(*) AS c, count(DISTINCT bigram) AS size, count(DISTINCT bigram) FILTER (list_contains(t.b, bigram)) AS same, any_value(len(t.b)) AS nt, any_value(lim) AS lim, any_value(license) AS license
  FROM runs JOIN n ON n.r = runs.r AND n.seg >= s AND n.seg2 <= runs.e JOIN t USING (k) GROUP BY runs.r, runs.k, s, runs.e, first_line, last_line),
f AS (SELECT *, 2 * same / (size + nt) AS dice FROM d WHERE c <= lim AND 2 * same / (size + nt) >= {threshold}),
z AS (SELECT *, row_number() OVER (ORDER BY dice DESC, nt DESC, e - s, s, k) AS rank FROM f),
cover AS (SELECT r, unnest(range(s, e + 1)) AS q, rank FROM z),
best AS (SELECT rank, count(*) AS n FROM (SELECT min(rank) AS rank FROM cover GROUP BY r, q) GROUP BY rank)
SELECT doc_id, CAST(first_line AS INTEGER) AS first_line, CAST(last_line AS INTEGER) AS last_line, license, round(dice, 6) AS dice FROM z JOIN best USING (rank) WHERE n = e - s + 1
"""
