"""License scans: MinHash bands over overlapping text windows, then exact containment.

Texts and templates are words (letters and digits, lower case) and their WIDTH-word
shingles. Windows begin every half of their length; a template belongs to the one of SCALES
that is two to four times its length in shingles, or, where there is none, to windows of
twice its length, so wherever it stands, a window holds all of it and is at most four times
as long (the smallest scale apart). Jaccard similarity is then about 1/4 or more (less by
the template's repeated shingles), and with BANDS bands of one row each the chance that no
band collides is (3/4) ** BANDS < 1e-8 for a whole copy; a copy that keeps CONTAINED of the
shingles still has under 1e-6. A window with fewer shingles of its templates than any of
them needs can't be verified and is skipped before it is sketched, which changes no result.
Retrieved templates are verified: the window must contain CONTAINED of the template's
shingles. Versions of a license that share that much are all named.

Cases: null and empty texts match nothing; texts are scanned whole; a template that is
found in several windows counts once; repeated rows get equal results; an empty table
gives no rows; other columns are not read. Templates are a fixed list (a parameter), so
what is broadcast doesn't grow with the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from importlib.resources import files

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._arrays import mix, shingles, Buffer, chunks

WIDTH, BANDS, CONTAINED = 3, 72, 0.8
SCALES = (24, 96, 384, 1536)

TEMPLATES = {
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "mit-line": "Released under the MIT License.",
    "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc-by-nd-4.0": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "cc-by-nc-sa-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
}
#: Whole texts, by the names of their files.
TEMPLATES |= {f"{f.name.removesuffix('.txt')}-text": f.read_text("utf-8") for f in (files(__package__) / "licenses").iterdir() if f.name.endswith(".txt")}

_NOT_WORD = np.ones(256, bool)
_NOT_WORD[48:58] = _NOT_WORD[65:91] = _NOT_WORD[97:123] = _NOT_WORD[128:] = False


def _clean(text: bytes) -> bytes:
    """Words of the text between single spaces; other bytes count as spaces."""
    data = np.frombuffer(text, np.uint8).copy()
    data[_NOT_WORD[data]] = 32
    return data.tobytes()


def shingle_lists(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of the texts in their order: (text of each, hash)."""
    words = Buffer([_clean(t) for t in texts], lower=True).words()
    _, doc, h = shingles(words, WIDTH)
    return doc, h


class Index:
    """Templates by the values of their bands."""

    def __init__(self, templates: dict[str, str] = TEMPLATES):
        self.names = sorted(templates)
        lists = [shingle_lists([templates[n].encode()])[1] for n in self.names]
        self.sets = [np.unique(x) for x in lists]
        if any(len(s) == 0 for s in self.sets):
            raise ValueError(f"a template has fewer than {WIDTH} words")
        self.scale = [next((s for s in SCALES if 2 * len(x) <= s <= max(4 * len(x), SCALES[0])), 2 * len(x)) for x in lists]
        self.salts = mix(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.bands: dict[int, dict[tuple[int, int], list[int]]] = {}
        for k, (x, scale) in enumerate(zip(self.sets, self.scale)):
            table = self.bands.setdefault(scale, {})
            for band, value in enumerate(self.minhash(x)):
                table.setdefault((band, int(value)), []).append(k)
        self.known = np.unique(np.concatenate(self.sets)) if self.sets else np.zeros(0, np.uint64)
        # of each scale: which of the known shingles its templates have, and the fewest that one of them needs
        own = [[x for x, own in zip(self.sets, self.scale) if own == scale] for scale in self.bands]
        self.member = np.array([np.isin(self.known, np.concatenate(x)) for x in own])
        self.least = np.array([CONTAINED * min(map(len, x)) for x in own])

    def minhash(self, h: np.ndarray) -> np.ndarray:
        return mix(h[None, :] ^ self.salts[:, None]).min(1)

    def find(self, h: np.ndarray, every: bool = False) -> set[int]:
        """Templates that a text with these shingles, in order, contains. every: sketch all windows, also those that have too few shingles of any template to be verified; the result is the same."""
        found: set[int] = set()
        if not len(self.known):
            return found
        place = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        hits = np.flatnonzero(self.known[place] == h)
        member = self.member[:, place[hits]]
        enough = member.sum(1) >= self.least
        for (scale, table), own, least, some in zip(self.bands.items(), member, self.least, enough):
            if not some and not every:
                continue
            half = scale // 2
            at = hits[own]
            steps = np.unique(np.concatenate([at // half, np.maximum(at // half - 1, 0)]))
            steps = np.arange(-(-len(h) // half)) if every else steps[np.searchsorted(at, steps * half + scale) - np.searchsorted(at, steps * half) >= least]
            for step in steps.tolist():
                window = np.unique(h[step * half : step * half + scale])
                for band, value in enumerate(self.minhash(window).tolist()):
                    for k in table.get((band, value), ()):
                        if k not in found and np.isin(self.sets[k], window, assume_unique=True).sum() >= CONTAINED * len(self.sets[k]):
                            found.add(k)
        return found


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """doc_id, n_licenses and licenses (names in order, joined by commas) of every row of docs."""
    index = docs.sparkSession.sparkContext.broadcast(Index(templates))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            out: list[str] = []
            for part in chunks([len(t) for t in texts]):
                doc, h = shingle_lists(texts[part])
                cuts = np.searchsorted(doc, np.arange(part.stop - part.start + 1))
                hit = np.zeros(part.stop - part.start, bool)
                hit[doc[np.isin(h, own.known)]] = True
                out += [",".join(own.names[k] for k in sorted(own.find(h[a:b]))) if some else "" for a, b, some in zip(cuts[:-1], cuts[1:], hit)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x.count(",") + 1 if x else 0 for x in out], pa.int64()), pa.array(out, pa.string())], names=["doc_id", "n_licenses", "licenses"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_licenses long, licenses string")


def op9(docs: DataFrame) -> DataFrame:
    return scan(docs)
