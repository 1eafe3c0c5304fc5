"""Licence scans by a positional index of rare tokens.

A template is a notice's words and its mandatory key phrases, which have places in it. How rare a word is comes from the number of
documents that hold it, counted over all of them. Each template is filed under its rarest mandatory word, with the places
of its other mandatory words behind it, rarest first. A file's licence words are looked up from the rarest on: the word's
places, less its place in the template, are where the template might begin; the next words' places are intersected with
these by relative position. At what is left the key phrases are verified word by word, and a template counts if also
`least` percent of its words are in place. Base phrases are templates that are mandatory as a whole.
Since all mandatory words have to be in place, no template that counts is missed, whatever the counts of documents; these
only make the lists short. The index is as large as the templates, which are fixed; texts aren't shuffled.
Defined results: a null or empty text has no words, no labels and a score of 0; the score is the best share of a counting
template's words in place, 1 for a base phrase; repeated rows give a row each; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, in_slices, utf8

#: Words: runs of letters and digits of ASCII, once it is in lower case, and of all characters beyond.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

#: The base phrases, by label.
BASE = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}

#: Notices of public licences, by label: their text and mandatory key phrases.
NOTICES = [
    ("agpl-3.0", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", ("gnu affero general public license", "free software foundation")),
    ("apache-2.0", "licensed under the apache license version 2.0", ("apache license", "version 2.0")),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2.0", ("except in compliance with the license", "apache org licenses")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "conditions are met")),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ("permission is hereby granted", "accompanying documentation covered by this license")),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4.0 international license", ("creative commons attribution 4.0",)),
    ("cc-by-nc-4.0", "licensed under cc by-nc 4.0", ("cc by nc", "4.0")),
    ("cc-by-sa-4.0", "this work is licensed under a creative commons attribution sharealike 4.0 international license", ("creative commons attribution sharealike",)),
    ("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright and related or neighboring rights",)),
    ("gpl-2.0+", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ("gnu general public license", "version 2 of the license", "any later version")),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify", "with or without fee is hereby granted")),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license", "free software foundation")),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted free of charge", "to deal in the software without restriction")),
    ("mit", "released under the mit license", ("mit license",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2.0", ("mozilla public license",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software", "public domain")),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", ("including commercial applications", "redistribute it freely")),
]


def words_of(text: str) -> list[bytes]:
    return WORD.findall(utf8(text).lower())


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    must: frozenset[int]
    base: bool


def template(label: str, text: str, phrases: tuple[str, ...], base: bool = False) -> Template:
    words = words_of(text)
    must: set[int] = set()
    for phrase in map(words_of, phrases):
        places = [k for k in range(len(words)) if words[k : k + len(phrase)] == phrase]
        if not places:
            raise ValueError(f"{b' '.join(phrase)!r} isn't in the template of {label}")
        must |= {k + j for k in places for j in range(len(phrase))}
    return Template(label, tuple(words), frozenset(must), base)


TEMPLATES = [template(label, text, (text,), True) for label, text in BASE.items()] + [template(*x) for x in NOTICES]


def document_counts(docs: DataFrame, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """In how many documents each word of a vocabulary of fixed size stands."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[bytes] = Counter()
        for _, texts in in_slices(batches):
            for text in texts:
                n.update(vocabulary.intersection(words_of(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], ["word", "n"])

    return {bytes(r["word"]): r["n"] for r in id_and_text(docs).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}


class Index:
    """Templates by their rarest mandatory word."""

    def __init__(self, templates: list[Template], held: dict[bytes, int]):
        self.by_word: dict[bytes, list[tuple[Template, list[int]]]] = {}
        for t in templates:
            places = sorted(t.must, key=lambda q: (held.get(t.words[q], 0), t.words[q], q))
            self.by_word.setdefault(t.words[places[0]], []).append((t, places))
        self.rarest = sorted(self.by_word, key=lambda w: (held.get(w, 0), w))
        self.licence_words = frozenset(t.words[q] for t in templates for q in t.must)

    def found(self, words: list[bytes], least: int) -> Iterator[tuple[Template, int, int]]:
        """Template, where it begins (below 0 where the file begins inside it), how many of its words are in place."""
        have = self.licence_words.intersection(words)
        keys = [w for w in self.rarest if w in have]
        asked = [(t, places) for w in keys for t, places in self.by_word[w] if all(t.words[q] in have for q in places)]
        if not asked:
            return
        wanted = {t.words[q] for t, places in asked for q in places}
        at: dict[bytes, set[int]] = {w: set() for w in wanted}
        for k, w in enumerate(words):
            if w in wanted:
                at[w].add(k)
        for t, places in asked:
            starts = {p - places[0] for p in at[t.words[places[0]]]}
            for q in places[1:]:
                if not starts:
                    break
                other = at[t.words[q]]
                starts = {s for s in starts if s + q in other}
            for s in starts:  # all mandatory words are in place; key phrases with them
                n = sum(s + q >= 0 and words[s + q : s + q + 1] == [w] for q, w in enumerate(t.words))
                if 100 * n >= least * len(t.words):
                    yield t, s, n


SCAN = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan(docs: DataFrame, templates: list[Template] | None = None, least: int = 80) -> DataFrame:
    templates = TEMPLATES if templates is None else templates
    vocabulary = frozenset(t.words[q] for t in templates for q in t.must)
    index = docs.sparkSession.sparkContext.broadcast(Index(templates, document_counts(docs, vocabulary)))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in in_slices(batches):
            out = []
            for doc, text in zip(ids, texts, strict=True):
                words = words_of(text)
                got = list(index.value.found(words, least))
                base = [s for t, s, _ in got if t.base]
                own, all_ = ({t.label for t, _, _ in got if t.base or wide} for wide in (False, True))
                out.append((doc, len(words), len(base), min(base, default=None), max(base, default=None), ",".join(sorted(own)), ",".join(sorted(all_)), max((n / len(t.words) for t, _, n in got), default=0.0)))
            kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in SCAN.split(", ")])

    return id_and_text(docs).mapInArrow(look, SCAN)
