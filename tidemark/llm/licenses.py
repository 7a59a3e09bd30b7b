"""License scan with a positional rare-token index.

The index holds the words of the license templates with their positions.  Of
each template the words with the highest inverse document frequency over the
templates are its anchors.  A file's occurrences of anchor words are looked up;
every (occurrence, posting) pair proposes that the template starts at their
distance, and proposals that several anchors share are the intersection of
postings by relative position.  Each is verified: the template's mandatory key
phrases must stand in the file where the template puts them, a few words of
slack allowed, and enough of its words must stand at their places.

Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z in lower case.
"""

from __future__ import annotations

import functools
import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm import arrays

#: phrase -> label, fixed values
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    keys: tuple[str, ...]  # mandatory phrases, as they stand in the text


#: opening clauses of public licenses and their usual notices
TEMPLATES = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("hereby granted free of charge", "deal in the software without restriction")),
    Template("mit", "released under the mit license", ("mit license",)),
    Template("apache", "licensed under the apache license version 2 0", ("apache license",)),
    Template("gpl", "this work is licensed under the gnu general public license version 3", ("gnu general public license",)),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("gnu general public license", "free software foundation")),
    Template("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ("lesser general public license",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("source and binary forms", "following conditions are met")),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    Template("cc-by", "licensed under cc by 4 0", ("cc by 4",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4",)),
)


class Index:
    """Postings of template words; words are numbered, -1 is any other word."""

    def __init__(self, templates: tuple[Template, ...], anchors: int, slack: int):
        self.templates, self.slack = templates, slack
        texts = [t.text.split() for t in templates]
        phrases = [p.split() for p in BASE_PHRASES]
        self.words = sorted({w for x in [*texts, *phrases] for w in x})
        number = {w: i for i, w in enumerate(self.words)}
        hashes = np.array([arrays.ALNUM_LOWER.hash(w) for w in self.words], np.uint64)
        order = np.argsort(hashes)
        self._hash, self._number = hashes[order], order
        self.texts = [np.array([number[w] for w in x]) for x in texts]
        df = Counter(w for x in self.texts for w in set(x.tolist()))
        self.idf = {w: math.log(1 + len(texts) / n) for w, n in df.items()}
        self.postings: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.needed = []
        for t, x in enumerate(self.texts):
            own = sorted(set(x.tolist()), key=lambda w: (-self.idf[w], w))[:anchors]
            for w in own:
                self.postings[w] += [(t, int(p)) for p in np.flatnonzero(x == w)]
            self.needed.append(min(3, len(own)))
        self.anchor = np.zeros(len(self.words) + 1, bool)  # the last one stands for -1
        self.anchor[list(self.postings)] = True
        self.keys = [[self._place(x, [number[w] for w in k.split()]) for k in t.keys] for t, x in zip(templates, self.texts, strict=True)]
        self.phrases = [([number[w] for w in p], label) for p, label in zip(phrases, BASE_PHRASES.values(), strict=True)]

    @staticmethod
    def _place(text: np.ndarray, phrase: list[int]) -> tuple[int, np.ndarray]:
        at = next(i for i in range(text.size) if text[i : i + len(phrase)].tolist() == phrase)
        return at, np.array(phrase)

    def numbers(self, h: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self._hash, h), self._hash.size - 1)
        return np.where(self._hash[at] == h, self._number[at], -1)

    def match(self, file: np.ndarray) -> dict[int, float]:
        """Verified templates of one file and the share of their words in place."""
        votes: Counter = Counter()
        for p in np.flatnonzero(self.anchor[file]).tolist():
            for t, q in self.postings[int(file[p])]:
                votes[t, p - q] += 1
        found: dict[int, float] = {}
        for (t, at), n in votes.items():
            if n < self.needed[t]:
                continue
            text = self.texts[t]
            where = at + np.arange(text.size)
            inside = (where >= 0) & (where < file.size)
            share = float((file[where[inside]] == text[inside]).sum() / text.size)
            if share >= 0.5 and all(self._near(file, at + k, phrase) for k, phrase in self.keys[t]):
                found[t] = max(found.get(t, 0.0), share)
        return found

    def _near(self, file: np.ndarray, at: int, phrase: np.ndarray) -> bool:
        for lo in range(max(0, at - self.slack), min(file.size - phrase.size, at + self.slack) + 1):
            if np.array_equal(file[lo : lo + phrase.size], phrase):
                return True
        return False


@functools.cache
def index(templates: tuple[Template, ...], anchors: int, slack: int) -> Index:
    return Index(templates, anchors, slack)


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, anchors: int = 6, slack: int = 4, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: key, n_words, n_base (places of base phrases), first_word and
    last_word (smallest and largest start of one, else null), base_labels,
    labels (base and verified template labels, sorted, comma-joined), templates
    (numbers of the verified templates), score (1 with a base phrase, else the
    largest share of a verified template's words that stand in place, else 0).

    Null and empty texts have no words and no labels; repeated rows get a row
    each; an empty table gives none.  One scan, no shuffle; the index is as large
    as the templates."""
    kind = docs.schema[key].dataType.simpleString()
    names = [key, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "templates", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index(templates, anchors, slack)
        for batch in batches:
            for rows, data, offsets in arrays.text_slices(batch, text):
                words = arrays.Words(data, offsets, arrays.ALNUM_LOWER)
                number = ix.numbers(words.hash)
                owner = words.text_of()
                n = offsets.size - 1
                base: dict[int, list[tuple[int, str]]] = defaultdict(list)
                for phrase, label in ix.phrases:
                    last = number.size - len(phrase) + 1
                    if last > 0:
                        hit = owner[:last] == owner[len(phrase) - 1 :]
                        for k, w in enumerate(phrase):
                            hit &= number[k : last + k] == w
                        for p in np.flatnonzero(hit).tolist():
                            base[int(owner[p])].append((p - int(words.ptr[owner[p]]), label))
                anchored = np.bincount(owner[ix.anchor[number]], minlength=n)
                out: list[list] = [[] for _ in range(7)]
                for d in range(n):
                    places = base.get(d, [])
                    found = ix.match(number[words.ptr[d] : words.ptr[d + 1]]) if anchored[d] > 1 else {}
                    own = {label for _, label in places}
                    at = [p for p, _ in places]
                    row = (len(at), min(at, default=None), max(at, default=None), ",".join(sorted(own)), ",".join(sorted(own | {templates[t].label for t in found})), sorted(found), 1.0 if at else round(max(found.values(), default=0.0), 6))
                    for column, x in zip(out, row, strict=True):
                        column.append(x)
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.float64()]
                yield pa.RecordBatch.from_arrays([rows.column(key), pa.array(words.counts(), pa.int64()), *(pa.array(c, t) for c, t in zip(out, types, strict=True))], names)

    schema = f"`{key}` {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, templates array<int>, score double"
    return docs.select(key, text).mapInArrow(run, schema)
