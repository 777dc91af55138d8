"""License scans: MinHash bands over overlapping windows find templates, exact containment verifies them.

Texts and templates are runs of five-word shingles. Templates fall into width classes: a class of width w
holds those of w/4 to w/2 shingles, counted once and as often as they stand, and its windows of w shingles
begin every w/2. A place of a template is a span of at most w shingles (so at least as many words as the
template has may be put into it) with 0.8 of its distinct shingles. Two windows hold it between them, so their
Jaccard similarities with the template add up to about 0.17 at least; BANDS bands of one MinHash each then
miss both with a chance under (1 - 0.087) ** (2 BANDS) < 0.0002. Candidates are verified on the window and one
width to both sides of it. Templates of one to four words are looked up as runs of their own length.

Every distinct place is a row; places of one template don't overlap.

Defined results: null, empty and wordless texts match nothing; a text of one to four words is one shingle; repeated rows match alike; an empty table gives an empty result. The templates are a table of
at most MAX_TEMPLATES rows; more raise an error.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralith.llm.common import chunks, mix, shingle_hashes, small_batches, table, utf8_column, word_hashes

BANDS, CONTAINED, MAX_TEMPLATES = 48, 0.8, 5000
_SEEDS = mix(np.arange(101, 101 + BANDS, dtype=np.uint64)) | np.uint64(1)

#: License notices.
NOTICES = [
    ("apache-2.0-line", "Licensed under the Apache License, Version 2.0."),
    ("mit-line", "Released under the MIT License."),
    ("gpl-3.0-line", "This work is licensed under the GNU General Public License, version 3."),
    ("cc-by-nc-4.0-line", "Licensed under CC BY-NC 4.0."),
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("apache-2.0-header", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("gpl-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("bsd-grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
]


def words_of(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    return word_hashes(data, np.array([0, len(data)]))[0]


class Templates:
    """Distinct shingles of every template, and by width class their MinHashes."""

    def __init__(self, rows: list[tuple[str, str]]):
        runs = [(name, words_of(text or "")) for name, text in rows]
        self.short = {n: [(name, shingle_hashes(w, n)[0]) for name, w in runs if len(w) == n] for n in range(1, 5)}
        sets = [(name, shingle_hashes(w)) for name, w in runs if len(w) > 4]
        self.times = [dict(zip(*(x.tolist() for x in np.unique(s, return_counts=True)), strict=True)) for _, s in sets]
        self.sets = [(name, np.unique(s)) for name, s in sets]
        self.classes: dict[int, np.ndarray] = {}
        self.width = [2] * len(sets)
        for k, (_, s) in enumerate(sets):
            for n in (len(self.sets[k][1]), len(s)):
                while n > self.width[k] // 2:
                    self.width[k] *= 2
                if k not in self.classes.setdefault(self.width[k], []):
                    self.classes[self.width[k]].append(k)
        mins = np.array([[(mix(s ^ seed)).min() for seed in _SEEDS] for _, s in self.sets], np.uint64).reshape(len(self.sets), BANDS)
        self.tables = {}
        for width, members in self.classes.items():
            members = np.array(members)
            for band in range(BANDS):
                order = np.argsort(mins[members, band], kind="stable")
                self.tables[width, band] = (mins[members, band][order], members[order])

    def windows(self, shingles: np.ndarray, first: np.ndarray):
        """(text, start, end, template) candidates; first: each text's first shingle."""
        found: set[tuple[int, int, int, int]] = set()
        spans = {}
        for width in self.classes:
            half = width // 2
            counts = np.diff(first)
            per = -(-counts // half)  # half blocks of each text
            text = np.repeat(np.arange(len(counts)), per)
            block = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
            spans[width] = (text, first[text] + block * half)
        for band, seed in enumerate(_SEEDS):
            hashed = mix(shingles ^ seed)
            for width in self.classes:
                text, starts = spans[width]
                if not len(starts):
                    continue
                low = np.minimum.reduceat(hashed, starts)
                both = low.copy()
                joined = np.flatnonzero(text[1:] == text[:-1])
                both[joined] = np.minimum(low[joined], low[joined + 1])
                values, members = self.tables[width, band]
                for side in range(len(values)):
                    for w in np.flatnonzero(both == values[side]):
                        t = int(text[w])
                        found.add((t, int(starts[w]), min(int(starts[w]) + width, int(first[t + 1])), int(members[side])))
        return found

    def places(self, shingles: np.ndarray, k: int) -> list[tuple[float, int]]:
        """(containment, first shingle) of the distinct places of a template in a run of shingles."""
        times, width = self.times[k], self.width[k]
        at = np.flatnonzero(np.isin(shingles, self.sets[k][1])).tolist()
        hits, need = shingles[at].tolist(), CONTAINED * len(times)
        out, i, j, free = [], 0, 0, 0
        held: dict[int, int] = {}

        def drop(h):
            held[h] -= 1
            if not held[h]:
                del held[h]

        while j < len(at):
            held[hits[j]] = held.get(hits[j], 0) + 1
            j += 1
            while at[j - 1] - at[i] >= width:
                drop(hits[i])
                i += 1
            if len(held) < need:
                continue
            while len(held) > need or held[hits[i]] > 1:
                if held[hits[i]] == 1 and len(held) - 1 < need:
                    break
                drop(hits[i])
                i += 1
            # what else of this occurrence follows, then what goes before: no shingle more often than in the template
            while j < len(at) and at[j] - at[i] < width and held.get(hits[j], 0) < times[hits[j]]:
                held[hits[j]] = held.get(hits[j], 0) + 1
                j += 1
            while i > free and at[j - 1] - at[i - 1] < width and held.get(hits[i - 1], 0) < times[hits[i - 1]]:
                i -= 1
                held[hits[i]] = held.get(hits[i], 0) + 1
            out.append((len(held) / len(times), at[i]))
            held.clear()
            i = free = j
        return out

    def matches(self, shingles: np.ndarray, first: np.ndarray) -> list[tuple[int, str, float, int]]:
        """(text, template, containment, first shingle) of every distinct place."""
        spans: dict[tuple[int, int], list[list[int]]] = {}
        for t, a, b, k in sorted(self.windows(shingles, first)):
            a, b = max(int(first[t]), a - self.width[k]), min(int(first[t + 1]), b + self.width[k])
            of = spans.setdefault((t, k), [])
            if of and a <= of[-1][1]:
                of[-1][1] = max(of[-1][1], b)
            else:
                of.append([a, b])
        return [(t, self.sets[k][0], share, a + at - int(first[t])) for (t, k), of in spans.items() for a, b in of for share, at in self.places(shingles[a:b], k)]

    def exact(self, words: np.ndarray) -> list[tuple[str, float, int]]:
        """(template, containment, first word) of the templates of one to four words in a text's words."""
        out = []
        for n, members in self.short.items():
            if members and len(words) >= n:
                runs = shingle_hashes(words, n)
                out += [(name, 1.0, int(x)) for name, h in members for x in np.flatnonzero(runs == h)]
        return out


def bounded_templates(templates: DataFrame) -> list[tuple[str, str]]:
    rows = templates.select("template_id", "text").limit(MAX_TEMPLATES + 1).collect()
    if len(rows) > MAX_TEMPLATES:
        raise ValueError(f"more than {MAX_TEMPLATES} license templates")
    return sorted((r["template_id"], r["text"]) for r in rows if r["template_id"] is not None)


def scan(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """doc_id, template_id, containment, start_word: a row for each place of a template in a row of docs."""
    spark = docs.sparkSession
    small_batches(spark)
    known = spark.sparkContext.broadcast(Templates(bounded_templates(templates)))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            data, offsets = utf8_column(batch.column("text"))
            rows, out = [], []
            for lo, hi in chunks(offsets):
                base = offsets[lo]
                words, _, _, at = word_hashes(data[base : offsets[hi]], offsets[lo : hi + 1] - base)
                each = [shingle_hashes(words[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
                first = np.cumsum([0, *map(len, each)])
                if not first[-1]:
                    continue
                found = known.value.matches(np.concatenate(each), first)
                found += [(t, *x) for t, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)) for x in known.value.exact(words[a:b])]
                for t, *x in sorted(found):
                    rows.append(lo + t)
                    out.append(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64()), pa.array([x[2] for x in out], pa.int64())],
                ["doc_id", "template_id", "containment", "start_word"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, template_id string, containment double, start_word bigint")


def notices(spark) -> DataFrame:
    return spark.createDataFrame(NOTICES, "template_id string, text string")


def op5_licenses(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), notices(spark))
