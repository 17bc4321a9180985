"""License scans by diagonal voting.

All rolling word k-gram hashes of all texts are joined with the grams of license templates. A match of
text position p with template position q votes for the diagonal p - q, once for each q. A diagonal needs
``grams // 40 + 1`` votes, so that a long template's everyday words make none. Neighbouring diagonals, as
small insertions and gaps leave them, are merged; and a merged span is verified word by word: how many of
the template's words, each counted once, stand in the span beside their right neighbours, that the words
which tell licenses apart are among them, and that the span is not much longer than the template. A phrase,
and a template of at most ``SHORT`` words, must be found whole on one diagonal: its places are exactly where its words
stand consecutively, so half of a short sentence that any text may hold labels nothing.

The template grams are broadcast after a check of their size. Texts are not shuffled: only votes are, and
they are gathered into sets before they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treefuse.llm.textarrays import LOWER, WORD, gram_hashes, parts, word_hashes, words

PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
# The wording of well-known licenses and of the notices that they ask for.
_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_TAIL = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_GNU_END = (
    "is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} General Public License for more details. "
    "You should have received a copy of the GNU {0} General Public License along with this"
)
TEMPLATES = [
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _WARRANTY, "mit"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("Released under the MIT License", "mit"),
    ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.", "apache"),
    ("Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License", "apache"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program " + _GNU_END.format("") + " program. If not, see https://www.gnu.org/licenses/", "gpl"),
    ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "gpl"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "gpl"),
    ("GNU General Public License", "gpl"),
    ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library " + _GNU_END.format("Lesser") + " library", "lgpl"),
    ("GNU Lesser General Public License", "lgpl"),
    ("GNU Affero General Public License", "agpl"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "agpl"),
    (_BSD_HEAD + " " + _BSD_TAIL, "bsd"),
    (_BSD_HEAD + " " + _BSD_NAMES + " " + _BSD_TAIL, "bsd"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "bsd"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "mpl"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License", "mpl"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.", "isc"),
    ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", "unlicense"),
    ("Creative Commons Attribution License", "cc-by"),
    ("Creative Commons Attribution 4.0 International License", "cc-by"),
    ("Creative Commons Attribution 3.0", "cc-by"),
    ("Creative Commons Attribution-ShareAlike", "cc-by-sa"),
    ("Creative Commons Attribution-NonCommercial", "cc-by-nc"),
    ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "cc0"),
    ("CC BY-NC 4.0", "cc-by-nc"),
]
TELLING = ["affero", "apache", "gnu", "lesser", "mozilla"]  # words that a longer template's span must hold, if the template does
K, SHORT = 2, 12


def text_words(text: str) -> np.ndarray:
    data = LOWER[np.frombuffer(text.encode(), np.uint8)]
    starts, ends, _ = words(data, np.array([0, len(data)]), WORD)
    return word_hashes(data, starts, ends)


def template_grams(spark: SparkSession, phrases: list[tuple[str, str]], templates: list[tuple[str, str]]) -> DataFrame:
    """gram, t (number), q (position), grams (in the template), label, phrase, whole (all grams on one diagonal): one row for
    each gram. A row with t = -1 stands for the mark that each text sends along with its number of words."""
    rows = [(0, -1, 0, 1, "", False, False)]
    for t, (text, label, phrase) in enumerate([(*p, True) for p in phrases] + [(*x, False) for x in templates]):
        found = gram_hashes(text_words(text), K).view(np.int64).tolist()
        if not found:
            raise ValueError(f"a template needs {K} words: {text!r}")
        rows += [(g, t, q, len(found), label, phrase, phrase or len(found) + K - 1 <= SHORT) for q, g in enumerate(found)]
    return spark.createDataFrame(rows, "gram bigint, t int, q int, grams int, label string, phrase boolean, whole boolean")


def telling_places(spark: SparkSession, phrases: list[tuple[str, str]], templates: list[tuple[str, str]]) -> DataFrame:
    """t, telling: for each telling word of a template, the positions of the grams that hold it."""
    rows = []
    for t, (text, _) in enumerate(phrases + templates):
        found = text_words(text).tolist()
        known = {w: int(text_words(w)[0]) for w in TELLING}
        places = [sorted({q for i, h in enumerate(found) if h == known[w] for q in (i - 1, i) if 0 <= q < len(found) - K + 1}) for w in TELLING if known[w] in found]
        rows.append((t, places))
    return spark.createDataFrame(rows, "t int, telling array<array<int>>")


def rolling_grams(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, h (the text's hash), n_words, p, gram; and one row with p = -1 and gram 0 a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in parts(batches, "__text", 1 << 18):
            data = LOWER[data]
            starts, ends, first = words(data, at, WORD)
            counts = np.diff(first)
            grams = gram_hashes(word_hashes(data, starts, ends), K)
            row = np.repeat(np.arange(len(counts)), counts)
            p = np.arange(len(row)) - first[row]
            whole = np.flatnonzero(p <= counts[row] - K)
            row = np.concatenate((np.arange(len(counts)), row[whole]))
            p = np.concatenate((np.full(len(counts), -1), p[whole]))
            grams = np.concatenate((np.zeros(len(counts), np.uint64), grams[whole] | np.uint64(grams[whole] == 0)))
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id").take(take), rows.column("h").take(take), pa.array(counts[row], pa.int64()), pa.array(p, pa.int32()), pa.array(grams.view(np.int64))],
                names=["doc_id", "h", "n_words", "p", "gram"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("h"), F.col("text").alias("__text")).mapInArrow(run, f"doc_id {kind}, h bigint, n_words bigint, p int, gram bigint")


def spans(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, slack: int = 3, least: float = 0.5, broadcast_bytes: int = 16 << 20) -> DataFrame:
    """docs(doc_id, text) -> doc_id, h, n_words, t, label, phrase, first, last, coverage: one row for each
    verified span, and one with t = -1 for each text.

    Null and empty texts have no words and only that row. Repeated document rows count once; rows of one
    doc_id with different texts are told apart by h. Other columns are ignored.
    """
    grams = template_grams(docs.sparkSession, phrases, templates)
    small = 96 * (sum(len(t) for t, _ in phrases + templates)) <= broadcast_bytes
    # A set of places: repeated rows of a text vote once, and no set is larger than its template.
    votes = (
        rolling_grams(docs).join(F.broadcast(grams) if small else grams, "gram")
        .groupBy("doc_id", "h", "t", "label", "phrase", "whole", "grams", (F.col("p") - F.col("q")).alias("diagonal"))
        .agg(F.collect_set("q").alias("places"), F.max("n_words").alias("n_words"))
        .where(F.size("places") >= F.when(F.col("whole"), F.col("grams")).otherwise(F.floor(F.col("grams") / 40) + 1))
    )
    # What is found whole stays on one diagonal, where nothing has to be merged; for other templates a new span begins
    # where the next diagonal is too far away.
    line = Window.partitionBy("doc_id", "h", "t", F.when(F.col("whole"), F.col("diagonal"))).orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(line) > slack, F.lit(True))
    merged = (
        votes.withColumn("span", F.sum(apart.cast("int")).over(line)).withColumn("span", F.when(F.col("whole"), F.col("diagonal")).otherwise(F.col("span")))
        .groupBy("doc_id", "h", "t", "label", "phrase", "whole", "grams", "span")
        .agg(
            F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"), F.max("n_words").alias("n_words"),
            F.min(F.col("diagonal") + F.array_min("places")).alias("first"), F.max(F.col("diagonal") + F.array_max("places") + K).alias("end"),
        )
    )
    # The words that these places cover, each once, out of the template's words.
    covered = F.size(F.array_distinct(F.flatten(F.transform("places", lambda q: F.transform(F.sequence(F.lit(0), F.lit(K - 1)), lambda j: q + j)))))
    merged = merged.withColumn("coverage", F.when(F.col("t") < 0, 0.0).otherwise(covered / (F.col("grams") + K - 1)))
    fits = F.col("end") - F.col("first") <= 2 * (F.col("grams") + K) + slack
    merged = merged.join(F.broadcast(telling_places(docs.sparkSession, phrases, templates)), "t", "left")  # a row a template
    told = F.forall("telling", lambda places: F.arrays_overlap(places, F.col("places")))
    ok = F.col("whole") | (F.col("t") < 0) | (fits & told & (F.col("coverage") >= least))
    return merged.where(ok).select("doc_id", "h", "n_words", "t", "label", "phrase", "first", (F.col("end") - 1).alias("last"), "coverage")


def scan(docs: DataFrame, **options) -> DataFrame:
    """One row a text: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (the best coverage)."""
    real, base = F.col("t") >= 0, F.col("phrase")
    labels = lambda where: F.array_join(F.sort_array(F.collect_set(F.when(where, F.col("label")))), ",")
    return (
        spans(docs, **options).groupBy("doc_id", "h")
        .agg(
            F.max("n_words").alias("n_words"), F.count(F.when(real & base, 1)).alias("n_base"),
            F.min(F.when(real & base, F.col("first"))).cast("long").alias("first_word"), F.max(F.when(real & base, F.col("first"))).cast("long").alias("last_word"),
            labels(real & base).alias("base_labels"), labels(real).alias("labels"), F.max("coverage").alias("score"),
        )
        .drop("h")
    )


def op6_licenses(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _values() -> str:
    rows = [(t, text, label, phrase) for t, (text, label, phrase) in enumerate([(*p, True) for p in PHRASES] + [(*x, False) for x in TEMPLATES])]
    return ", ".join("({}, '{}', '{}', {})".format(t, text.replace("'", "''"), label, phrase) for t, text, label, phrase in rows)


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH tw AS (SELECT *, phrase OR len(w) <= {SHORT} AS whole FROM (SELECT t, label, phrase, {_WORDS} AS w FROM (VALUES {_values()}) v(t, text, label, phrase))),
tg AS (SELECT t, label, phrase, whole, i - 1 AS q, w[i] || ' ' || w[i + 1] AS gram, len(w) - 1 AS grams FROM tw, unnest(range(1, len(w))) u(i)),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
dg AS (SELECT doc_id, i - 1 AS p, w[i] || ' ' || w[i + 1] AS gram FROM d, unnest(range(1, len(w))) u(i)),
votes AS (
  SELECT doc_id, t, label, phrase, whole, grams, p - q AS diagonal, list_sort(list(DISTINCT q)) AS places FROM dg JOIN tg USING (gram) GROUP BY ALL
  HAVING count(DISTINCT q) >= CASE WHEN whole THEN grams ELSE grams // 40 + 1 END
), marked AS (
  SELECT *, whole OR coalesce(diagonal - lag(diagonal) OVER w > 3, true) AS apart FROM votes WINDOW w AS (PARTITION BY doc_id, t ORDER BY diagonal)
), numbered AS (SELECT *, sum(apart::INTEGER) OVER (PARTITION BY doc_id, t ORDER BY diagonal) AS span FROM marked),
merged AS (
  SELECT doc_id, t, label, phrase, whole, grams, span, list_distinct(flatten(list(places))) AS places, min(diagonal + list_min(places)) AS first, max(diagonal + list_max(places)) + 2 AS stop
  FROM numbered GROUP BY doc_id, t, label, phrase, whole, grams, span
), measured AS (
  SELECT *, len(list_distinct(list_concat(places, list_transform(places, lambda q: q + 1)))) / (grams + 1)::DOUBLE AS coverage FROM merged
), telling AS (SELECT t, x, i - 1 AS place FROM tw, unnest(range(1, len(w) + 1)) u(i), unnest({TELLING}) v(x) WHERE w[i] = x),
missing AS (
  SELECT doc_id, t, span FROM measured JOIN telling USING (t) WHERE NOT whole GROUP BY doc_id, t, span, x
  HAVING NOT bool_or(list_contains(places, place) OR list_contains(places, place - 1))
), fit AS (
  SELECT * FROM measured m WHERE whole OR (stop - first <= 2 * (grams + 2) + 3 AND coverage >= 0.5 AND NOT EXISTS (SELECT 1 FROM missing x WHERE x.doc_id = m.doc_id AND x.t = m.t AND x.span = m.span))
), found AS (
  SELECT doc_id, count(*) FILTER (phrase) AS n_base, min(first) FILTER (phrase) AS first_word, max(first) FILTER (phrase) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (phrase) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(coverage)::DOUBLE AS score
  FROM fit GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN found USING (doc_id)
"""
