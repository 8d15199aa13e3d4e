"""License scan: overlapping text windows find templates by MinHash bands, exact containment decides.

A document is cut at white space into words (lower-cased letters and digits only). For each template length the text has
overlapping windows of twice that length, stepping by the length, so that every occurrence of a template lies whole in
some window of at most twice its shingles. The windows' and templates' MinHash signatures are cut into bands;
rows and bands are set from the lowest similarity that a window around a true occurrence can have, so that it shares a
band with probability ``1 - miss`` at least. Retrieved templates are verified by the exact share of their shingles
that the window contains. Windows that have too few of the shingles of the templates of their length have nothing to find and get no
signature: that test is exact. All verified windows are reported, overlapping ones of one name as one. Templates are a bounded list; they go to the tasks by broadcast, and no document moves.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specula.llm._worker import once, slices
from specula.llm.bpe import _q
from specula.llm.ngramjoin import _mixed

#: Statements that licenses ask for or that are in common use. (name, text)
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "either version 3 of the License, or (at your option) any later version"),
    ("GPL-2.0", "either version 2 of the License, or (at your option) any later version"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version."),
]
WORD = re.compile(r"[^\W_]+")


def whole_texts() -> list[tuple[str, str]]:
    """(name, text) of the whole licenses beside this module; read on the driver only."""
    return [(p.stem, p.read_text(encoding="utf-8")) for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))]


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def bands_for(least: float, miss: float) -> tuple[int, int]:
    """(rows, bands): the most selective banding that a window around a true occurrence fails with at most ``miss``.

    ``least`` is the lowest similarity that such a window can have; a signature has at most 256 hashes, or one row a band.
    """
    best = (1, 0)
    for rows in range(1, 9):
        bands = math.ceil(math.log(miss) / math.log1p(-min(least, 0.999) ** rows))
        if rows == 1 or rows * bands <= 256:
            best = (rows, bands)
    return best


class Matcher:
    def __init__(self, templates: list[tuple[str, str]], shingle: int, containment: float, miss: float):
        import numpy as np
        import xxhash
        self.hash = lambda ws: xxhash.xxh3_64_intdigest(" ".join(ws))
        self.containment = containment
        self.items, self.starts = [], set()
        for name, text in templates:
            words = words_of(text)
            if words:
                k = min(shingle, len(words))
                self.starts.update(words[:len(words) - k + 1])
                self.items.append((name, len(words), k, frozenset(self.hash(words[i:i + k]) for i in range(len(words) - k + 1))))
        self.lengths = sorted({(n, k) for _, n, k, _ in self.items})
        self.sets = {p: frozenset(h for _, n, k, s in self.items if (n, k) == p for h in s) for p in self.lengths}
        self.fewest = {p: containment * min(len(s) for _, n, k, s in self.items if (n, k) == p) for p in self.lengths}
        self.every = frozenset(h for s in self.sets.values() for h in s)
        #: templates of other names that hold so much of a template that they tell what it is part of
        self.wider = [{j for j, (other, *_, t) in enumerate(self.items) if other != name and len(s & t) >= containment * len(s)} for name, *_, s in self.items]
        self.plans = {}
        for n, k in self.lengths:
            size = n - k + 1
            held = math.ceil(containment * size)
            least = held / (size + (2 * n - k + 1) - held)
            rows, bands = bands_for(least, miss)
            draw = np.random.default_rng([n, k])
            a, b = (draw.integers(1, 1 << 63, rows * bands, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
            table: dict = {}
            for i, (_, m, kk, s) in enumerate(self.items):
                if (m, kk) == (n, k):
                    for band in self._bands(s, a, b, rows, bands):
                        table.setdefault(band, set()).add(i)
            self.plans[n, k] = (a, b, rows, bands, table)

    @staticmethod
    def _bands(shingles, a, b, rows: int, bands: int):
        import numpy as np
        h = np.fromiter(shingles, np.uint64, len(shingles))
        low = _mixed(a[:, None] * h + b[:, None]).min(axis=1)
        return [(i, low[i * rows:(i + 1) * rows].tobytes()) for i in range(bands)]

    def scan(self, text: str | None) -> list[tuple[str, int, int, float]]:
        """(name, first word, words, share) of the verified windows; overlapping ones of a name are one, with the best share.

        A template that is mostly a part of another name's gives way where windows overlap and the other has more shingles there.
        """
        words = words_of(text)
        places = [i for i, w in enumerate(words) if w in self.starts]
        known = {k: [(i, h) for i in places if i + k <= len(words) and (h := self.hash(words[i:i + k])) in self.every] for k in {k for _, k in self.lengths}}
        hits: list[tuple[int, int, int, int]] = []  # template, start, end, shingles found
        for n, k in self.lengths:
            a, b, rows, bands, table = self.plans[n, k]
            held = [x for x in known[k] if x[1] in self.sets[n, k]]
            at = [i for i, _ in held]
            for start in sorted({s for i in at for s in (i // n * n, i // n * n - n) if s >= 0}):
                part = words[start:start + 2 * n]
                there = {h for _, h in held[bisect_left(at, start):bisect_left(at, start + len(part) - k + 1)]}
                if len(there) < self.fewest[n, k]:
                    continue
                inside = {self.hash(part[i:i + k]) for i in range(len(part) - k + 1)}
                for i in sorted({i for band in self._bands(inside, a, b, rows, bands) for i in table.get(band, ())}):
                    found = len(there & self.items[i][3])
                    if found >= self.containment * len(self.items[i][3]):
                        hits.append((i, start, start + len(part), found))
        out: list[tuple[str, int, int, float]] = []
        by: dict[int, list[tuple[int, int, int, int]]] = {}
        for h in hits:
            by.setdefault(h[0], []).append(h)

        def gives_way(h) -> bool:
            for j in self.wider[h[0]] & by.keys():
                first = bisect_left(by[j], h[1] - 2 * self.items[j][1] + 1, key=lambda o: o[1])
                if any(o[3] > h[3] and o[2] > h[1] for o in by[j][first:bisect_left(by[j], h[2], key=lambda o: o[1])]):
                    return True
            return False
        kept = [h for h in hits if not gives_way(h)]
        for name, start, end, share in sorted((self.items[i][0], start, end, found / len(self.items[i][3])) for i, start, end, found in kept):
            if out and out[-1][0] == name and start < out[-1][1] + out[-1][2]:
                _, first, size, best = out[-1]
                out[-1] = (name, first, max(size, end - first), max(best, share))
            else:
                out.append((name, start, end - start, share))
        return out


def scan(docs: DataFrame, text: str, keep: list[str], templates: list[tuple[str, str]] | None = None,
         shingle: int = 5, containment: float = 0.8, miss: float = 1e-6) -> DataFrame:
    """Columns ``keep`` with licenses, an array of (name, start, words, share), empty if there is none.

    One entry for each place of each license name: its verified windows as far as they overlap, with the largest share of a template's shingles.
    ``templates`` are ``TEMPLATES`` and the whole licenses of ``whole_texts`` unless given.
    Templates shorter than ``shingle`` words are one shingle. Null and empty texts have no licenses, whole texts are read; repeated
    rows give repeated results, an empty table an empty one. No row moves.
    A kept column named licenses gives way.
    """
    templates = TEMPLATES + whole_texts() if templates is None else templates
    keep = [c for c in keep if c != "licenses"]
    fields = [f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.select(*[_q(c) for c in keep]).schema]
    held = docs.sparkSession.sparkContext.broadcast((templates, shingle, containment, miss))

    def run(batches):
        import pyarrow as pa
        matcher = once(("licenses", repr(held.value)), lambda: Matcher(*held.value))
        kind = pa.list_(pa.struct([("name", pa.string()), ("start", pa.int32()), ("words", pa.int32()), ("share", pa.float64())]))
        for batch in slices(batches):
            found = [[dict(zip(("name", "start", "words", "share"), h)) for h in matcher.scan(t)] for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, kind)], names=[*keep, "licenses"])
    return docs.select(*[_q(c) for c in keep], _q(text).alias("__text")).mapInArrow(
        run, ", ".join([*fields, "licenses array<struct<name:string,start:int,words:int,share:double>>"]))
