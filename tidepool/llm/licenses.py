"""Licence scan: lines of text against licence notices by the Dice coefficient over word bigrams.

A text's segments are its lines and, where it has several, the whole text (a licence spread over lines). A segment's words are
runs of a-z and digits, with dots inside them, in lower case; its bigrams are counted with their repeats. Dice is
2 |A and B| / (|A| + |B|), so a template can reach `least` only while |A| lies between |B| least / (2 - least) and
|B| (2 - least) / least: segments outside every template's bounds are dropped by their word count before any bigram is made. The best template of a document has the largest Dice, then the smaller name, then the earlier line.

Beside that, `licenses` lists every licence found anywhere in the text, whatever lines it is wrapped over and whatever stands
around it: windows of words whose Dice with a template is `least` or more. A best window starts and ends with a bigram of the
template, so only those are tried, where enough of them lie within the largest size. Of windows that overlap, the one with the
larger Dice stays; each licence is listed once, as name:dice:line of its best window (the line where it starts), by name.

Templates are short notices and the full texts in license_texts. Null and empty text have no licence (nulls, zero and an
empty list in the result). Repeated rows repeat their result; an empty table gives no rows; further columns are ignored.
Whole texts of any length are scanned.
"""

import bisect
import math
import pkgutil
import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame

#: Licence notices by name.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0 Universal."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3."],
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0."],
    "Proprietary": ["All rights reserved.", "All rights reserved. No part of this work may be reproduced without permission."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}
for _name in ("Apache-2.0", "BSD-3-Clause", "CC0-1.0", "GPL-3.0", "ISC", "LGPL-3.0", "MIT", "MPL-2.0"):
    TEMPLATES[_name].append(pkgutil.get_data("tidepool.llm", f"license_texts/{_name}.txt").decode())
WORD = re.compile(r"[a-z0-9]+(?:\.[a-z0-9]+)*")


def bigrams(words: list[str]) -> Counter:
    return Counter(zip(words, words[1:]))


def windows(at: list[int], pairs: list[tuple[str, str]], b: Counter, n: int, least: float) -> list[tuple[float, int, int]]:
    """(dice, first, last) of the best windows, apart from each other; at are the places in pairs of bigrams of template b."""
    most, need = math.floor(n * (2 - least) / least + 1e-9), math.ceil(n * least / (2 - least) - 1e-9)
    out: list[tuple[float, int, int]] = []
    busy = [True] * len(at)  # whether the largest window from a place on holds enough bigrams, repeats clipped
    seen: Counter = Counter()
    overlap = high = 0
    for k, p in enumerate(at):
        while high < len(at) and at[high] < p + most:
            pair = pairs[at[high]]
            overlap += seen[pair] < b[pair]
            seen[pair] += 1
            high += 1
        busy[k] = overlap >= need
        seen[pairs[p]] -= 1
        overlap -= seen[pairs[p]] < b[pairs[p]]
    best = None
    for k in range(len(at)):
        if best and at[k] > best[2]:
            out.append(best)
            best = None
        reach = min(bisect.bisect_left(at, at[k] + most) - k, n)
        if busy[k] and (best is None or 2 * reach / (reach + n) > best[0]):
            left, o = {}, 0
            for j in range(k, len(at)):
                size = at[j] - at[k] + 1
                if size > most:
                    break
                pair = pairs[at[j]]
                if (rest := left.get(pair, b[pair])) > 0:
                    left[pair] = rest - 1
                    o += 1
                    dice = 2 * o / (size + n)
                    if dice >= least and (best is None or dice > best[0]):
                        best = (dice, at[k], at[j])
    return [*out, best] if best else out


def apart(found: list[tuple[float, int, int, str]]) -> dict[str, tuple[float, int]]:
    """By licence: Dice and first place of the best window that no better one overlaps."""
    starts, ends, kept = [], [], {}
    for dice, first, last, name in sorted(found, key=lambda x: (-x[0], x[1] - x[2], x[3], x[1])):
        k = bisect.bisect_right(starts, last)
        if k and ends[k - 1] >= first:
            continue
        starts.insert(k, first)
        ends.insert(k, last)
        kept.setdefault(name, (dice, first))
    return kept


def scan(docs: DataFrame, least: float = 0.8, templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """(doc_id, license, dice, line, n_license_lines, licenses): lines count from 1; in line, 0 stands for the whole text."""
    known = [(name, bigrams(w), len(w) - 1) for name in sorted(templates) for t in templates[name] if len(w := WORD.findall(t.lower())) > 1]
    bounds = [(n * least / (2 - least) - 1e-9, n * (2 - least) / least + 1e-9) for _, _, n in known]  # floats: a Dice of just `least` lies inside
    of: dict[tuple[str, str], list[int]] = defaultdict(list)
    for t, (_, b, _) in enumerate(known):
        for pair in b:
            of[pair].append(t)
    of.default_factory = None

    def best(segment: str, due: list[int]) -> tuple[float, str] | None:
        words = WORD.findall(segment)
        size = len(words) - 1
        due = [t for t in due if bounds[t][0] <= size <= bounds[t][1]]
        if not due:
            return None
        a, found = bigrams(words), None
        for t in due:
            name, b, n = known[t]
            dice = 2 * (a & b).total() / (size + n)
            if dice >= least - 1e-9 and (found is None or dice > found[0]):
                found = (dice, name)
        return found

    def look(text: str) -> tuple[str | None, float | None, int | None, int, str]:
        text = text.lower()
        words = WORD.findall(text)
        pairs = list(zip(words, words[1:]))
        places: dict[int, list[int]] = defaultdict(list)
        for p, pair in enumerate(pairs):
            if pair in of:
                for t in of[pair]:
                    places[t].append(p)
        due = [t for t in sorted(places) if len(places[t]) >= bounds[t][0]]
        if not due:  # a segment has no more of a template's bigrams than the text
            return None, None, None, 0, ""
        kept = apart([(*w, known[t][0]) for t in due for w in windows(places[t], pairs, known[t][1], known[t][2], least)])
        if kept:
            starts = [m.start() for m in WORD.finditer(text)]
        listed = ",".join(f"{name}:{dice:.6f}:{text.count(chr(10), 0, starts[p]) + 1}" for name, (dice, p) in sorted(kept.items()))
        lines = text.split("\n")
        hits = [(-hit[0], hit[1], k) for k, line in enumerate(lines, 1) if (hit := best(line, due))]
        n = len(hits)
        if len(lines) > 1 and (hit := best(text, due)):
            hits.append((-hit[0], hit[1], 0))
        if not hits:
            return None, None, None, 0, listed
        dice, name, line = min(hits)
        return name, round(-dice, 6), line, n, listed

    def run(batches):
        for b in batches:
            rows = [look(t or "") for t in b.column(1).to_pylist()]
            cols = list(zip(*rows)) or [(), (), (), (), ()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.string())))], names=["doc_id", "license", "dice", "line", "n_license_lines", "licenses"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, license string, dice double, line long, n_license_lines long, licenses string")
