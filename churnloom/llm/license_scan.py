"""License notices by an exact set-similarity join of text blocks with license templates.

A block is a stretch of twice a template's words; blocks start every template length, so that any passage of
the template's length lies within one. A block matches where it holds at least a share ``threshold`` of the
template's distinct words. The words are ordered by the number of documents that hold them, rarest first, and
the join is the usual one on that order: a block that matches must hold one of the template's first words
(prefix), enough words at all (length) and enough of them after the first common one (position); what passes
is counted in full. Templates are few and of checked size, so their side of the join is broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnloom.llm.common import parts, received, send, ship

# The base phrases of the contract and the wording of common notices, in words of lower case.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
TEMPLATES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
     "documentation files the software to deal in the software without restriction including without limitation the "
     "rights to use copy modify merge publish distribute sublicense and or sell copies of the software", "mit"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with "
     "the license you may obtain a copy of the license at", "apache-2"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general "
     "public license as published by the free software foundation either version 3 of the license or at your option "
     "any later version", "gpl-3"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the "
     "following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not "
     "distributed with this file you can obtain one at", "mpl-2"),
    ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("all rights reserved no part of this publication may be reproduced distributed or transmitted in any form or by "
     "any means without the prior written permission of the publisher", "all-rights-reserved"),
)
THRESHOLD = 0.8
# Most bytes of templates that are broadcast.
TEMPLATE_BYTES = 16 << 20
# Bytes of a text that are cut into words at once.
SLICE = 1 << 20

# Bytes of words stay, A-Z in lower case; all others become blanks. Bytes of other scripts are words.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

SCHEMA = ("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
          "matches array<struct<template: int, label: string, first_word: long, n_common: int, containment: double>>")


@dataclass
class Template:
    """A template in the order of its words' frequency."""

    number: int
    label: str
    length: int           # its words, repeats counted; blocks start this far apart
    ranks: np.ndarray     # its distinct words, rarest first
    least: int            # distinct words that a block must share

    @property
    def prefix(self) -> np.ndarray:
        """A block without any of these shares too few of the others."""
        return self.ranks[:len(self.ranks) - self.least + 1]


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


def least_common(size: int, threshold: float) -> int:
    """Words to share: the share of ``size`` rounded up, without the noise of the product."""
    return max(1, int(np.ceil(round(size * threshold, 9))))


def numbered(text: bytes, numbers: dict[bytes, int]) -> np.ndarray:
    """The number of every word of a text, -1 for words without one; slices bound the memory."""
    found, at = [], 0
    plain = text.translate(_WORDS)
    while at < len(plain):
        end = len(plain) if len(plain) - at <= SLICE else plain.find(b" ", at + SLICE)
        end = len(plain) if end < 0 else end
        words = plain[at:end].split()
        found.append(np.fromiter(map(numbers.get, words, repeat(-1)), np.int32, len(words)))
        at = end
    return np.concatenate(found) if found else np.empty(0, np.int32)


def _texts(batches):
    """Rows of bounded batches with their text as bytes; null is empty."""
    for batch in parts(batches):
        texts = batch.column(batch.num_columns - 1).cast(pa.large_binary()).to_pylist()
        yield batch, [t or b"" for t in texts]


def word_frequencies(texts: DataFrame, vocabulary: list[bytes]) -> dict[bytes, int]:
    """In how many of ``texts`` (one column) each of the given words occurs."""
    numbers = texts.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(vocabulary)})

    def run(batches):
        total = np.zeros(len(numbers.value) + 1, np.int64)  # the last is that of words without number
        for _, held in _texts(batches):
            for text in held:
                total[np.unique(numbered(text, numbers.value))] += 1
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total) - 1), pa.int32()), pa.array(total[:-1])], ["word", "n"])

    found = texts.mapInArrow(run, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    counts = dict(zip(*(c.to_pylist() for c in found.columns), strict=True))
    return {w: counts.get(i, 0) for i, w in enumerate(vocabulary)}


class Scanner:
    """Finds phrases and templates in the numbers of a text's words; numbers follow frequency, rarest first."""

    def __init__(self, frequencies: dict[bytes, int], phrases, templates, threshold: float):
        order = sorted(frequencies, key=lambda w: (frequencies[w], w))
        self.numbers = {w: i for i, w in enumerate(order)}
        self.phrases = [(np.array([self.numbers[w] for w in words_of(p.encode())]), label) for p, label in phrases]
        self.templates = []
        for number, (text, label) in enumerate(templates):
            words = words_of(text.encode())
            ranks = np.unique([self.numbers[w] for w in words])
            self.templates.append(Template(number, label, len(words), ranks, least_common(len(ranks), threshold)))
        self.of_phrase, self.of_prefix, in_template = (np.zeros(len(order) + 1, bool) for _ in range(3))
        self.of_phrase[[p[0] for p, _ in self.phrases]] = True
        for t in self.templates:
            self.of_prefix[t.prefix] = True
            in_template[t.ranks] = True
        self.in_template = in_template

    def places(self, words: np.ndarray, phrase: np.ndarray) -> np.ndarray:
        """Where the words of a phrase stand one after another."""
        at = np.flatnonzero(words[:len(words) - len(phrase) + 1] == phrase[0])
        for i, word in enumerate(phrase[1:], 1):
            at = at[words[at + i] == word]
        return at

    def blocks(self, words: np.ndarray, rare: np.ndarray, template: Template):
        """``(first word, words in common)`` of the blocks that match."""
        near = rare[np.isin(words[rare], template.prefix)] // template.length
        for block in np.unique(np.concatenate([near, near[near > 0] - 1])):
            first = int(block) * template.length
            held = np.unique(words[first:first + 2 * template.length])
            held = held[self.in_template[held]]
            if len(held) < template.least:
                continue
            common = np.isin(held, template.ranks)
            mine = int(common.argmax())
            its = int(np.searchsorted(template.ranks, held[mine]))
            if min(len(held) - mine, len(template.ranks) - its) < template.least:
                continue
            if (n := int(common.sum())) >= template.least:
                yield first, n

    def scan(self, text: bytes) -> dict:
        words = numbered(text, self.numbers)
        places, base, matches = [], set(), []
        if self.of_phrase[words].any():
            for phrase, label in self.phrases:
                at = self.places(words, phrase)
                if len(at):
                    places.append(at)
                    base.add(label)
        rare = np.flatnonzero(self.of_prefix[words])
        if len(rare):
            for t in self.templates:
                matches += [{"template": t.number, "label": t.label, "first_word": first, "n_common": n,
                             "containment": n / len(t.ranks)} for first, n in self.blocks(words, rare, t)]
        at = np.concatenate(places) if places else np.empty(0, np.int64)
        return {
            "n_words": len(words), "n_base": len(at),
            "first_word": int(at.min()) if len(at) else None, "last_word": int(at.max()) if len(at) else None,
            "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | {m["label"] for m in matches})),
            "score": 1.0 if base else max((m["containment"] for m in matches), default=0.0), "matches": matches}


def license_scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, threshold: float = THRESHOLD,
                 text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """License phrases and template matches of every row of ``docs``, one row each.

    ``n_base`` counts the places of all ``phrases``, ``first_word`` and ``last_word`` are the smallest and largest
    (null without any). ``matches`` lists each block and template that match, ``labels`` adds their labels to
    ``base_labels``. ``score`` is 1 with a phrase, else the best containment of a match, else 0. ``phrases`` and
    ``templates`` are pairs of text and label; ValueError if they hold more than ``TEMPLATE_BYTES`` or one has no word.

    A null or empty text has no words, no labels (empty strings) and score 0. Repeated rows and ids, also null ones,
    are scanned row by row. Whole texts are read, in slices. Other columns are not read. Equally frequent words are
    ordered by themselves; their order and the filters never change a result. An empty table gives an empty one.
    """
    given = [t for t, _ in (*phrases, *templates)]
    if sum(len(t.encode()) for t in given) > TEMPLATE_BYTES or not all(words_of(t.encode()) for t in given):
        raise ValueError("templates and phrases need words, and must be small enough to broadcast")
    vocabulary = sorted({w for t in given for w in words_of(t.encode())})
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    frequencies = word_frequencies(rows.select("text"), vocabulary)
    sent = send(docs.sparkSession, Scanner(frequencies, phrases, templates, threshold))
    names = [f.split()[0] for f in SCHEMA.split(", ")[:7]] + ["matches"]
    match = pa.list_(pa.struct([("template", pa.int32()), ("label", pa.string()), ("first_word", pa.int64()),
                                ("n_common", pa.int32()), ("containment", pa.float64())]))
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), match]

    def run(batches):
        scanner = received(sent)
        for batch, texts in _texts(batches):
            found = [scanner.scan(t) for t in texts]
            columns = [pa.array([f[n] for f in found], kind) for n, kind in zip(names, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *names])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {SCHEMA}")


def _sql() -> str:
    """The same in SQL: words in order, phrases by neighbours, blocks by counting what they share."""
    def values(pairs):
        return ", ".join(f"({i}, '{t}', '{label}')" for i, (t, label) in enumerate(pairs))

    return rf"""
WITH given(nr, phrase, label) AS (VALUES {values(PHRASES)}),
phrases AS (SELECT nr, label, string_split(phrase, ' ') AS words FROM given),
notices(nr, notice, label) AS (VALUES {values(TEMPLATES)}),
templates AS (SELECT nr, label, len(string_split(notice, ' ')) AS size, list_distinct(string_split(notice, ' ')) AS words FROM notices),
docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
tokens AS (SELECT r, unnest(words) AS word, unnest(range(len(words))) AS pos FROM docs),
places AS (
  SELECT t.r, t.pos, p.label FROM tokens t JOIN phrases p ON t.word = p.words[1] JOIN docs d ON d.r = t.r
  WHERE d.words[t.pos + 1 : t.pos + len(p.words)] = p.words),
base AS (
  SELECT r, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT label) AS labels
  FROM places GROUP BY r),
vocabulary AS (SELECT nr, label, size, len(words) AS distinct_words, unnest(words) AS word FROM templates),
hits AS (SELECT t.r, v.nr, v.label, v.distinct_words, t.pos // v.size AS block, t.word FROM tokens t JOIN vocabulary v ON t.word = v.word),
blocks AS (
  SELECT r, nr, label, distinct_words, block, count(DISTINCT word) AS common FROM (
    FROM hits UNION ALL SELECT r, nr, label, distinct_words, block - 1, word FROM hits WHERE block > 0)
  GROUP BY r, nr, label, distinct_words, block),
found AS (
  SELECT r, list(DISTINCT label) AS labels, max(common / distinct_words) AS best FROM blocks
  WHERE common >= ceil(round(distinct_words * {THRESHOLD}, 9)) GROUP BY r)
SELECT d.doc_id, len(d.words) AS n_words, coalesce(b.n_base, 0) AS n_base, b.first_word, b.last_word,
  coalesce(array_to_string(list_sort(b.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(f.labels, [])))), ','), '') AS labels,
  CASE WHEN b.r IS NOT NULL THEN 1.0::DOUBLE ELSE coalesce(f.best, 0.0)::DOUBLE END AS score
FROM docs d LEFT JOIN base b ON b.r = d.r LEFT JOIN found f ON f.r = d.r"""


ORACLE = _sql()

ship(__name__)
