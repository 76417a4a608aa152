"""Licence notices in texts by a positional index of rare words.

The index holds, for each word of the templates, its places in them. Of each
template a text's rarest words there, by the corpus's own document counts, are
looked up; a place in the text less the place in the template says where the
template would begin, and only beginnings that those words agree on are
candidates. A candidate is verified: the template's key phrases must stand
there, and the words found in place must make up a share of the template's
weight. Base phrases are templates that must stand there whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tokens import slices
from .words import Words, split_words

# Bytes that end a word: all of ASCII but digits and a-z; A-Z are lower-cased first.
_OUTSIDE = np.ones(256, bool)
_OUTSIDE[0x30:0x3A] = _OUTSIDE[0x61:0x7B] = _OUTSIDE[0x80:] = False
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: Rare words of a template that are looked up in a text, how many of them must agree, places by which they may differ, and the share of a template's weight that must be found.
ANCHORS, AGREE, SLACK, SHARE = 3, 2, 2, 0.7


@dataclass(frozen=True)
class Template:
    """A notice: label, text, phrases that must stand in it; ``base`` ones stand whole and count at every place."""

    label: str
    text: str
    keys: tuple[str, ...]
    base: bool = False


def _phrase(label: str, text: str) -> Template:
    return Template(label, text, (text,), base=True)


#: Base phrases, and notices as licences ask for them, each with phrases without which it is another text.
TEMPLATES: tuple[Template, ...] = (
    _phrase("cc-by", "cc by"),
    _phrase("gpl", "general public license"),
    _phrase("reserved", "all rights reserved"),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license",)),
    Template("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind", ("unless required by applicable law", "as is basis")),
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "licensed under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("source and binary forms",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee",)),
    Template("gpl-3", "this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("free software foundation", "general public license")),
    Template("lgpl", "licensed under the gnu lesser general public license", ("lesser general public license",)),
    Template("agpl", "licensed under the gnu affero general public license", ("affero general public license",)),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("cc-by-nd", "licensed under cc by nd 4 0", ("cc by nd",)),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
    Template("cc0", "to the extent possible under law the author has waived all copyright and related rights to this work", ("waived all copyright",)),
    Template("public-domain", "this is free and unencumbered software released into the public domain", ("into the public domain",)),
)


def _words(text: str) -> list[str]:
    return _WORD.findall(text)


class Index:
    """Postings of the templates' words: for each template its word numbers, their weights, key phrases by place, and distinct words from the rarest."""

    def __init__(self, templates: tuple[Template, ...], idf: dict[str, float] | None = None):
        self.templates = templates
        self.vocabulary = list(dict.fromkeys(w for t in templates for w in _words(t.text)))
        self.number = {w.encode(): k for k, w in enumerate(self.vocabulary)}
        weights = np.array([(idf or {}).get(w, 1.0) for w in self.vocabulary])
        self.codes, self.keys, self.rarest, self.weights = [], [], [], []
        for t in templates:
            codes = np.array([self.number[w.encode()] for w in _words(t.text)])
            whole, places = _words(t.text), []
            for key in map(_words, t.keys):
                at = next(k for k in range(len(whole)) if whole[k : k + len(key)] == key)
                places.append(np.arange(at, at + len(key)))
            distinct = np.unique(codes)
            self.codes.append(codes)
            self.keys.append(places)
            self.weights.append(weights[codes] / weights[codes].sum())
            self.rarest.append(distinct[np.lexsort((distinct, -weights[distinct]))])

    def numbered(self, words: Words) -> np.ndarray:
        """The word number at each place of a batch, -1 for words of no template."""
        codes, first = words.numbered()
        if not len(codes):
            return np.zeros(0, np.int64)
        return np.array([self.number.get(w, -1) for w in words.at(first)], np.int64)[codes]

    def present(self, words: Words, numbers: np.ndarray) -> np.ndarray:
        """Which documents have which words."""
        doc = np.repeat(np.arange(len(words.bounds) - 1), np.diff(words.bounds))
        hit = np.flatnonzero(numbers >= 0)
        found = np.zeros((len(words.bounds) - 1, len(self.vocabulary)), bool)
        found[doc[hit], numbers[hit]] = True
        return found

    def search(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, template, place of its first word, share) of all verified candidates: every place of a base phrase, and the best place of any other template in a document."""
        numbers = self.numbered(words)
        present = self.present(words, numbers)
        doc = np.repeat(np.arange(len(words.bounds) - 1), np.diff(words.bounds))
        hit = np.flatnonzero(numbers >= 0)
        hit = hit[np.argsort(numbers[hit], kind="stable")]
        edges = np.searchsorted(numbers[hit], np.arange(len(self.vocabulary) + 1))
        out = [(np.zeros(0, np.int64),) * 3 + (np.zeros(0),)]
        for t, template in enumerate(self.templates):
            codes = self.codes[t]
            # texts that have all words of the key phrases; of those, each one's rarest words of this template
            open_to = present[:, codes[np.concatenate(self.keys[t])]].all(axis=1)
            if not open_to.any():
                continue
            slack, anchors = (0, 1) if template.base else (SLACK, ANCHORS)
            ranked = present[:, self.rarest[t]] & open_to[:, None]
            looked_up = ranked & (np.cumsum(ranked, axis=1) <= anchors)
            begins = []
            for k in np.flatnonzero(looked_up.any(axis=0)).tolist():
                code = self.rarest[t][k]
                places = hit[edges[code] : edges[code + 1]]
                places = places[looked_up[doc[places], k]]
                begins.append(np.unique(np.concatenate([(doc[places] << 40) + places - p + len(codes) for p in np.flatnonzero(codes == code).tolist()])))
            some = np.unique(np.concatenate(begins))
            agree = sum((np.searchsorted(b, some + slack, "right") > np.searchsorted(b, some - slack, "left")).astype(np.int64) for b in begins)
            d = some >> 40
            some, d = (x[agree >= np.minimum(1 if template.base else AGREE, looked_up.sum(axis=1)[d])] for x in (some, d))
            at = (some & ((1 << 40) - 1)) - len(codes)
            share = self._verified(t, numbers, words.bounds[d], words.bounds[d + 1], at, slack)
            fits = share >= (1 - 1e-9 if template.base else SHARE)
            d, at, share = d[fits], at[fits], share[fits]
            if not template.base and len(d):
                order = np.lexsort((at, -share, d))
                order = order[np.r_[True, d[order][1:] != d[order][:-1]]]
                d, at, share = d[order], at[order], share[order]
            out.append((d, np.full(len(d), t), np.maximum(at - words.bounds[d], 0), share))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def _verified(self, t: int, numbers: np.ndarray, low: np.ndarray, high: np.ndarray, at: np.ndarray, slack: int) -> np.ndarray:
        """The share of the template's weight found in place; 0 where a key phrase does not stand there."""
        codes, found = self.codes[t], np.zeros((len(at), len(self.codes[t])), bool)
        keys = np.zeros((len(at), len(self.keys[t])), bool)
        padded = np.append(numbers, -1)
        for shift in range(-slack, slack + 1):
            places = at[:, None] + np.arange(len(codes)) + shift
            inside = (places >= low[:, None]) & (places < high[:, None])
            same = padded[np.where(inside, places, len(numbers))] == codes
            found |= same
            for k, key in enumerate(self.keys[t]):
                keys[:, k] |= same[:, key].all(axis=1)
        return np.where(keys.all(axis=1), found @ self.weights[t], 0.0)


def document_counts(texts: DataFrame, index: Index) -> dict[str, float]:
    """Inverse document frequencies of the templates' words over all of ``texts`` (one column)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = np.zeros(len(index.vocabulary), np.int64), 0
        for batch in batches:
            for some in slices(batch, 0):
                words = split_words(some.column(0), lower=True, outside=_OUTSIDE)
                found += index.present(words, index.numbered(words)).sum(axis=0)
                n += some.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(found))), pa.array(np.append(n, found))], ["word", "n"])

    rows = texts.mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()  # a row for each word of the templates
    n = {r["word"]: r["n"] for r in rows}
    return {w: float(np.log((n.get(-1, 0) + 1) / (n.get(k, 0) + 1)) + 1e-3) for k, w in enumerate(index.vocabulary)}


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, found (label, base, start, words, share: ``start`` in words from 0; by place).

    Texts are read whole; a null text counts as empty and has no words; rows of
    one id are texts of their own; a base phrase is found at every place where
    it stands, overlapping ones too, any other template at its best place in a
    text, the first of equals. Only the two columns are read; an empty table
    gives no rows.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    bare = Index(templates)
    index = Index(templates, document_counts(source.select("text"), bare))
    lengths = np.array([len(c) for c in index.codes])
    labels, base = np.array([t.label for t in templates]), np.array([t.base for t in templates])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, 1):
                words = split_words(some.column(1), lower=True, outside=_OUTSIDE)
                d, t, start, share = index.search(words)
                order = np.lexsort((t, start, d))
                d, t, start, share = d[order], t[order], start[order], share[order]
                rows = pa.StructArray.from_arrays([pa.array(labels[t]), pa.array(base[t]), pa.array(start.astype(np.int64)), pa.array(lengths[t]), pa.array(np.minimum(share, 1.0))], ["label", "base", "start", "words", "share"])
                found = pa.ListArray.from_arrays(pa.array(np.searchsorted(d, np.arange(some.num_rows + 1)).astype(np.int32)), rows)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(np.diff(words.bounds).astype(np.int64)), found], ["doc_id", "n_words", "found"])

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(each, f"doc_id {kind}, n_words long, found array<struct<label:string,base:boolean,start:long,words:long,share:double>>")


def joined_labels(found: Column) -> Column:
    """Distinct labels, sorted, with commas."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda x: x["label"]))), ",")


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of ``scan``; score is the largest share of a template found, 0 for none."""
    base = F.filter("found", lambda x: x["base"])
    starts = F.transform(base, lambda x: x["start"])
    return scan(docs).select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined_labels(base).alias("base_labels"),
        joined_labels(F.col("found")).alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda x: x["share"])), F.lit(0.0)).alias("score"),
    )
