"""Licence notices: candidate blocks are compressed with each template as a raw dictionary.

Around every cue word a block of words is taken.  The template that, as a zstandard raw
dictionary, shortens a block's frame the most says most of the block.  Templates are
tried in that order, to the last one, until the exact words confirm one: the notice around
the cue must hold all key words of the template, and differ from it in few words.  That one
gives the licence.  As a block also holds a notice's neighbours, place and differences are
those of the licence's wording that differs the least, then of the longest.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cue words, as a pattern that Spark and Python read alike; share of words that may differ, and words that may in short templates.
CUES, DIFFERENT, FEW = r"(?i)licen[cs]e|copyright|permission is hereby|redistribution\s+and\s+use|spdx", 0.1, 2
LEVEL = 3


@dataclass(frozen=True)
class Template:
    """A notice's wording, and the words that no notice of this licence lacks."""

    name: str
    text: str
    keys: tuple[str, ...]

    @property
    def words(self) -> list[str]:
        return plain(self.text)


# Short notices, the openings of the licences' own notices, and SPDX tags.
TEMPLATES = [
    Template("MIT", "Released under the MIT License.", ("mit", "license")),
    Template("MIT", "Licensed under the MIT License.", ("mit", "license")),
    Template("Apache-2.0", "Licensed under the Apache License, Version 2.0.", ("apache", "license", "2.0")),
    Template("GPL-3.0", "This work is licensed under the GNU General Public License, version 3.", ("gnu", "general", "3")),
    Template("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.", ("cc", "by-nc", "4.0")),
    Template("CC-BY-4.0", "Licensed under CC BY 4.0.", ("cc", "by", "4.0")),
    Template("GPL-2.0", "This work is licensed under the GNU General Public License, version 2.", ("gnu", "general", "2")),
    Template("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction", ("permission", "free", "charge", "restriction")),
    Template("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", ("redistribution", "source", "binary", "conditions")),
    Template("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at", ("apache", "license", "2.0", "compliance")),
    *(Template(f"GPL-{v}.0", f"This program is free software{mark} you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation{stop} either version {v} of the License, or (at your option) any later version.", ("gnu", "general", v)) for v, mark, stop in (("2", ";", ";"), ("3", ":", ","))),
    *(Template(name, f"This work is licensed under a Creative Commons {kind} 4.0 International License.", ("creative", "commons", kind.lower(), "4.0")) for name, kind in (("CC-BY-4.0", "Attribution"), ("CC-BY-NC-4.0", "Attribution-NonCommercial"))),
    *(
        Template(name, f"SPDX-License-Identifier: {tag}", ("spdx-license-identifier", tag.lower()))
        for name, tags in {"MIT": ("MIT",), "Apache-2.0": ("Apache-2.0",), "BSD": ("BSD-2-Clause", "BSD-3-Clause"), "GPL-2.0": ("GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later"), "GPL-3.0": ("GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later"), "CC-BY-4.0": ("CC-BY-4.0",), "CC-BY-NC-4.0": ("CC-BY-NC-4.0",)}.items()
        for tag in tags
    ),
]


def plain(text: str) -> list[str]:
    """Lower-case words without the punctuation around them."""
    return [w for w in (x.strip(".,;:()[]\"'") for x in text.lower().split()) if w]


def blocks(text: str, reach: int) -> Iterator[tuple[int, list[str], list[int]]]:
    """(cue, words, positions in the text's words) of ``reach`` words to both sides of every cue word."""
    raw = text.split()
    at, hits = 0, []
    starts = []
    for w in raw:
        at = text.index(w, at)
        starts.append(at)
        at += len(w)
    for m in re.finditer(CUES, text):
        hits.append(bisect.bisect_right(starts, m.start()) - 1)
    done = -1
    for h in hits:
        if h <= done:
            continue
        done = h
        low, high = max(0, h - reach), min(len(raw), h + reach + 1)
        kept = [(i, w) for i in range(low, high) if (w := raw[i].lower().strip(".,;:()[]\"'"))]
        yield h, [w for _, w in kept], [i for i, _ in kept]


@lru_cache(maxsize=1)
def _compressors(templates: tuple[Template, ...]):
    bare = zstandard.ZstdCompressor(level=LEVEL)
    return bare, [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(" ".join(t.words).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for t in templates]


def align(words: list[str], want: list[str], cue: int, most: int) -> tuple[int, int, int] | None:
    """(size of differences, first, end) of the span of words, with ``cue`` in it, that differs least from ``want``.

    A span starts and ends with words of the template; ``most`` bounds the size.
    """
    places: dict[str, list[int]] = {}
    for i, w in enumerate(want):
        places.setdefault(w, []).append(i)
    best, chains = None, []  # (place in words, place in want, size so far, first)
    for j in range(max(0, cue - len(want) - most), min(len(words), cue + len(want) + most)):
        chains = [c for c in chains if j - c[0] - 1 <= most]
        new = []
        for i in places.get(words[j], ()):
            starts = [(i, -j)] if i <= most and j <= cue else []
            starts += [(size + max(i - i0, j - j0) - 1, -first) for j0, i0, size, first in chains if i0 < i]
            size, first = min(starts, default=(most + 1, 0))  # of equal ones the shortest
            if size <= most:
                new.append((j, i, size, -first))
                whole = (size + len(want) - 1 - i, first, j + 1)
                if j >= cue and whole[0] <= most and (best is None or whole < best):
                    best = whole
        chains += new
    return best and (best[0], -best[1], best[2])


def confirm(words: list[str], template: Template, cue: int) -> tuple[int, int, list[str]] | None:
    """(first, end, differences) of the notice that holds the block's word ``cue``, or None."""
    want = template.words
    if any(k not in words for k in template.keys):
        return None
    span = align(words, want, cue, max(FEW, int(DIFFERENT * len(want))))
    if not span:
        return None
    _, first, end = span
    found = words[first:end]
    if any(k not in found for k in template.keys):
        return None
    changes = [c for c in SequenceMatcher(None, want, found, autojunk=False).get_opcodes() if c[0] != "equal"]
    return first, end, [f"{tag}:{' '.join(want[b1:b2])}:{' '.join(found[a1:a2])}" for tag, b1, b2, a1, a2 in changes]


def ranked(words: list[str], templates: tuple[Template, ...]) -> list[tuple[int, int]]:
    """(template, bytes it takes off the block's frame as a dictionary) of every template, the most first."""
    bare, with_dict = _compressors(templates)
    block = " ".join(words).encode()
    size = len(bare.compress(block))
    return sorted(((i, size - len(c.compress(block))) for i, c in enumerate(with_dict)), key=lambda x: (-x[1], x[0]))


def find(text: str, templates: tuple[Template, ...]) -> list[dict]:
    """The notices of one text: licence, place in its words, size reduction, differences."""
    out: dict[tuple[str, int], dict] = {}
    for cue, words, places in blocks(text, max(len(t.words) for t in templates) + FEW):
        if (at := bisect.bisect_left(places, cue)) == len(places) or places[at] != cue:
            continue
        hits = {}
        for i, reduction in ranked(words, templates):
            if (not hits or templates[i].name == name) and (hit := confirm(words, templates[i], at)):
                name, hits[i] = templates[i].name, (reduction, hit)
        if hits:
            i = min(hits, key=lambda i: (len(hits[i][1][2]), -len(templates[i].words), -hits[i][0], i))
            reduction, hit = hits[i]
            place = places[hit[0]]
            out.setdefault((name, place), {"licence": name, "first_word": place, "n_words": hit[1] - hit[0], "reduction": reduction, "differences": hit[2]})
    return sorted(out.values(), key=lambda x: (x["first_word"], x["licence"]))


def scan(docs: DataFrame, templates: tuple[Template, ...] = tuple(TEMPLATES), *columns: str) -> DataFrame:
    """One row for each notice found: doc_id, licence, first_word, n_words, reduction, differences.

    Null and empty texts have none; each row is read on its own, so repeated rows give
    repeated notices; other columns are ignored.  Texts without a cue never reach Python.
    """
    kept = docs.where(F.col("text").rlike(CUES)).select("doc_id", *columns, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                for x in find(text, templates):
                    rows.append(i)
                    found.append(x)
            take = pa.array(rows, pa.int64())
            kinds = {"licence": pa.string(), "first_word": pa.int64(), "n_words": pa.int64(), "reduction": pa.int64(), "differences": pa.list_(pa.string())}
            names = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in names), *(pa.array([x[k] for x in found], t) for k, t in kinds.items())], names=[*names, *kinds])

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.drop("text").schema)
    return kept.mapInArrow(run, f"{head}, licence string, first_word long, n_words long, reduction long, differences array<string>")
