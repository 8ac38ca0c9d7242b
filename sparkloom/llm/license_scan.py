"""License scans: phrases whose words stand consecutively, and an exact set-similarity join of text blocks with license notices.

A block is a run of consecutive words of the text, across lines, of at most the template's length / THRESHOLD words; a template is
a notice; both are sets of words. A block matches if it holds THRESHOLD of a template's words (containment). The join is exact: the
templates' words are ordered by the number of documents of the whole corpus that have them, rarest first; a text with a block that
matches holds one of a template's first |T| - ceil(threshold * |T|) + 1 words (prefix filter: an inverted index from these words to
templates, so that a text meets only those it shares one with), has ceil(threshold * |T|) words or more (length filter), and its first
match among the ordered words leaves enough of them behind it (positional filter). In texts that pass, blocks slide over the places of
the template's words; of blocks that overlap, the fullest and then first counts, and a span's line is that of its first word. The
templates are a parameter, a dictionary or a table of at most MOST_TEMPLATES rows (label, text), so each task holds them; texts are
never shuffled.

Cases: a null text is the empty text (no words, places or labels); a phrase may cross lines and any separators; ties and repeated
rows are each judged by themselves; very long texts take time in proportion to their length; a template without words matches nothing;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm._base import documents, text_of

#: Bytes of a word: digits, letters and all that isn't ASCII; A-Z are lower-cased, all others separate words.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
TEMPLATES = {
    # whole notices
    "apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
        You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,
        software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or
        implied. See the License for the specific language governing permissions and limitations under the License.""",
    "bsd-2-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are
        met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
        documentation and/or other materials provided with the distribution.""",
    "gpl-3.0-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the
        Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it
        will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
    "mit-notice": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"),
        to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense,
        and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above
        copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.""",
    # sentences
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "mit": "Released under the MIT License",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
}
THRESHOLD = 0.9
MOST_TEMPLATES = 5000


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORDS).split()


def token_counts(docs: DataFrame, tokens: set[bytes]) -> dict[bytes, int]:
    """In how many of all documents each of the templates' words stands; one row a word reaches the driver."""

    def count(batches):
        seen = dict.fromkeys(sorted(tokens), 0)
        for batch in batches:
            for text in batch.column(0):
                for w in tokens.intersection(words_of(text.as_py().encode())):
                    seen[w] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    rows = docs.select(text_of().alias("text")).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {bytes(r["word"]): r["n"] for r in rows}


def templates_of(given) -> dict[str, str]:
    """Label to text, of a dictionary or a table (label, text); rows without a text are left out, a table over the bound is refused."""
    if not isinstance(given, DataFrame):
        return dict(TEMPLATES if given is None else given)
    rows = given.select("label", "text").filter("label IS NOT NULL AND text IS NOT NULL").limit(MOST_TEMPLATES + 1).collect()
    if len(rows) > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} templates")
    return {r["label"]: r["text"] for r in rows}


class Templates:
    """(label, words in global order, least overlap) of each template, and the index of their prefixes."""

    def __init__(self, templates: dict[str, str], counts: dict[bytes, int], threshold: float):
        self.all, self.widths = [], {}
        for label, text in sorted(templates.items()):
            words = words_of(text.encode())
            tokens = sorted(set(words), key=lambda w: (counts.get(w, 0), w))
            if tokens:
                self.all.append((label, tokens, math.ceil(threshold * len(tokens) - 1e-9)))
                self.widths[label] = math.ceil(len(words) / threshold - 1e-9)
        self.index: dict[bytes, list[tuple[int, int]]] = {}
        for k, (_, tokens, need) in enumerate(self.all):
            for place, w in enumerate(tokens[: len(tokens) - need + 1]):
                self.index.setdefault(w, []).append((k, place))

    def matches(self, block: set[bytes]) -> list[tuple[str, float]]:
        """Labels and containments of the templates that a block matches."""
        first: dict[int, int] = {}
        for w in self.index.keys() & block:
            for k, place in self.index[w]:
                first[k] = min(place, first.get(k, place))
        found = []
        for k in sorted(first):
            label, tokens, need = self.all[k]
            if len(block) >= need and len(tokens) - first[k] >= need:
                common = sum(w in block for w in tokens[first[k] :])
                if common >= need:
                    found.append((label, common / len(tokens)))
        return found


def blocks(words: list[bytes], tokens: list[bytes], need: int, width: int) -> list[tuple[int, float]]:
    """(first word, containment) of the blocks of at most width words that hold need of the tokens or more; they don't overlap."""
    of = set(tokens)
    places = [k for k, w in enumerate(words) if w in of]
    have, lo, found, best = Counter(), 0, [], None  # best: containment, begin, end (places) of the blocks that overlap
    hi = 0
    while hi < len(places):
        have[words[places[hi]]] += 1
        while places[hi] - places[lo] >= width or have[words[places[lo]]] > 1:
            have[words[places[lo]]] -= 1
            if not have[words[places[lo]]]:
                del have[words[places[lo]]]
            lo += 1
        if best and lo > best[2]:
            found.append(best)
            best = None
        if len(have) >= need and (best is None or len(have) > best[0]):
            best = (len(have), lo, hi)
        hi += 1
        if best and (len(have) == len(of) or hi == len(places)):  # can't be fuller, or no more words
            found.append(best)
            best, lo, hi, have = None, best[2] + 1, best[2] + 1, Counter()
    return [(places[begin], n / len(of)) for n, begin, _ in found]


def scan_text(text: bytes, phrases, templates: Templates) -> tuple:
    """n_words, n_base, first, last, base labels, spans (label, line, containment)."""
    words = words_of(text)
    joined = b" " + b" ".join(words) + b" "
    places, base = [], set()
    for pattern, label in phrases:
        at = upto = 0  # a place and the words before it
        for m in pattern.finditer(joined):
            upto, at = upto + joined.count(b" ", at, m.start()), m.start()
            places.append(upto)
            base.add(label)
    spans, held = [], set(words)
    may = {label for label, _ in templates.matches(held)}
    if may:
        found = [(at, label, c) for label, tokens, need in templates.all if label in may for at, c in blocks(words, tokens, need, templates.widths[label])]
        if found:
            upto = list(accumulate(len(words_of(line)) for line in text.split(b"\n")))
            spans = [(label, bisect_right(upto, at), c) for at, label, c in sorted(found)]
    return len(words), len(places), min(places, default=None), max(places, default=None), sorted(base), spans


SCHEMA = (
    "n_words long, n_base long, first_word long, last_word long, base_labels array<string>, "
    "spans array<struct<label:string,line:int,containment:double>>"
)
ARROW = [
    ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.list_(pa.string())),
    ("spans", pa.list_(pa.struct([("label", pa.string()), ("line", pa.int32()), ("containment", pa.float64())]))),
]


def license_scan(docs: DataFrame, phrases=None, templates=None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, counts and places of the phrases, base_labels, and the matching blocks as spans."""
    given = templates_of(templates)
    tokens = {w for t in given.values() for w in words_of(t.encode())}
    planned = Templates(given, token_counts(docs, tokens) if tokens else {}, threshold)
    # a phrase's last space is looked at, not taken: the next place may begin there
    phrase_list = [(b" " + p.encode() + b"(?= )", label) for p, label in (PHRASES if phrases is None else phrases).items()]
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        compiled = [(re.compile(p), label) for p, label in phrase_list]
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                rows = [scan_text(t.as_py().encode(), compiled, planned) for t in batch.column(1)]
                made = [pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(ARROW[:5])]
                spans = [[{"label": s[0], "line": s[1], "containment": s[2]} for s in r[5]] for r in rows]
                yield pa.RecordBatch.from_arrays([batch.column(0), *made, pa.array(spans, ARROW[5][1])], ["doc_id", *(n for n, _ in ARROW)])

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, f"doc_id {kind}, {SCHEMA}")


def query(spark, sf_dir):
    own = F.transform("spans", lambda s: s["label"])
    best = F.array_max(F.transform("spans", lambda s: s["containment"]))
    return license_scan(documents(spark, sf_dir)).select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_distinct(F.concat("base_labels", own))), ",").alias("labels"),
        F.greatest(F.coalesce(best, F.lit(0.0)), F.when(F.col("n_base") > 0, 1.0).otherwise(0.0)).alias("score"),
    )


def sql() -> str:
    """The query's rows: phrases by neighbouring words; templates by the most of their words within any run of the block's width."""
    made = Templates(TEMPLATES, {}, THRESHOLD)
    rows = ", ".join(f"('{label}', '{w.decode()}', {len(tokens)}, {need}, {made.widths[label]})" for label, tokens, need in made.all for w in sorted(tokens))
    return rf"""WITH t(label, w, size, need, width) AS (VALUES {rows}),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
p AS (SELECT doc_id, i, ws[i + 1] AS w, ws[i + 2] AS w2, ws[i + 3] AS w3 FROM (SELECT doc_id, ws, unnest(range(len(ws))) AS i FROM d)),
b AS (SELECT doc_id, i, CASE WHEN w = 'cc' AND w2 = 'by' THEN 'cc-by' WHEN w = 'general' AND w2 = 'public' AND w3 = 'license' THEN 'gpl' WHEN w = 'all' AND w2 = 'rights' AND w3 = 'reserved' THEN 'reserved' END AS label FROM p),
base AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b WHERE label IS NOT NULL GROUP BY doc_id),
hit AS (SELECT doc_id, i, w, label, size, need, width FROM p JOIN t USING (w)),
may AS (SELECT doc_id, label FROM hit GROUP BY doc_id, label, need HAVING count(DISTINCT w) >= need),
run AS (SELECT x.doc_id, x.label, x.i, any_value(x.size) AS size, any_value(x.need) AS need, count(DISTINCT y.w) AS n FROM (SELECT * FROM hit SEMI JOIN may USING (doc_id, label)) x
  JOIN hit y ON y.doc_id = x.doc_id AND y.label = x.label AND y.i >= x.i AND y.i < x.i + x.width GROUP BY 1, 2, 3),
own AS (SELECT doc_id, label, max(n) / any_value(size) AS c FROM run GROUP BY doc_id, label HAVING max(n) >= any_value(need)),
labels AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM own UNION ALL SELECT doc_id, label FROM b WHERE label IS NOT NULL) GROUP BY doc_id),
best AS (SELECT doc_id, max(c) AS c FROM own GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  greatest(coalesce(c, 0.0), CASE WHEN n_base > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN labels USING (doc_id) LEFT JOIN best USING (doc_id)"""


SQL = sql()
