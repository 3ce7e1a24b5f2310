"""License scan: fixed phrases, and an exact set-similarity join of text blocks with license templates.

A block is a line of a text, or a run of as many consecutive words as a template has, across line ends (a wrapped notice;
where the text begins, fewer). A template is a short notice. Both count as sets of words. A block matches a template when it
holds at least `threshold` of the template's words. Words are ordered by how many lines of the whole corpus hold them,
rarest first. A block can only match if it holds one of the template's first |T| - a + 1 words in that order (prefix
filter; a is the least number of common words), has a words at all (length filter), and if behind the first common
word enough words are left on both sides (positional filter). What passes is verified, so no match is lost. Runs are met by
their last word of the template, for each template apart.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import with_defaults
from .tokens import ALNUM, byte_values, token_hash, tokens

#: Phrase words -> label.
PHRASES = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}

#: Notice -> label.
TEMPLATES = {
    "Licensed under the Apache License, Version 2.0": "apache-2.0",
    "Released under the MIT License": "mit",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files": "mit",
    "This work is licensed under the GNU General Public License, version 3": "gpl-3.0",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License": "gpl",
    "Licensed under CC BY-NC 4.0": "cc-by-nc",
    "Licensed under CC BY-SA 4.0": "cc-by-sa",
    "This work is licensed under a Creative Commons Attribution 4.0 International License": "cc-by",
    "Redistribution and use in source and binary forms, with or without modification, are permitted": "bsd",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0": "mpl-2.0",
    "This is free and unencumbered software released into the public domain": "unlicense",
}

#: Text of a template table, at most.
TEMPLATE_BYTES = 8 << 20

#: Share of a template's words that a block must hold.
THRESHOLD = 0.8

_VALUES = byte_values(fold_case=True)


def words_of(text: str) -> list[str]:
    """Words of a phrase or template: ASCII letters and digits and all beyond ASCII, A-Z lower-cased."""
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded) if w]


class Index:
    """Templates over a vocabulary ranked rarest first: word sets, least overlaps, and which templates a prefix word points to."""

    def __init__(self, templates: dict[str, str], threshold: float, rank: dict[int, int] | None = None):
        sets = [sorted({int(token_hash(w, _VALUES)) for w in words_of(t)}) for t in templates]
        vocabulary = sorted({w for s in sets for w in s}, key=lambda w: ((rank or {}).get(w, 0), w))
        place = {w: i for i, w in enumerate(vocabulary)}
        self.threshold = threshold
        self.labels = list(templates.values())
        self.by_hash = np.array(sorted(vocabulary), np.uint64)
        self.rank = np.array([place[w] for w in sorted(vocabulary)], np.int64)
        self.sets = [np.array(sorted(place[w] for w in s), np.int64) for s in sets]
        self.least = [max(1, math.ceil(threshold * len(s) - 1e-9)) for s in sets]
        self.prefix: dict[int, list[int]] = {}
        for t, (s, a) in enumerate(zip(self.sets, self.least, strict=True)):
            for w in s[: len(s) - a + 1].tolist():
                self.prefix.setdefault(w, []).append(t)
        self.in_prefix = np.isin(np.arange(len(vocabulary)), list(self.prefix))
        self.lengths = [len(words_of(t)) for t in templates]
        # 1 for a template's words, 2 for those of its prefix
        self.member = np.zeros((len(templates), len(vocabulary)), np.int8)
        for t, (words, a) in enumerate(zip(self.sets, self.least, strict=True)):
            self.member[t, words] = 1
            self.member[t, words[: len(words) - a + 1]] = 2

    def pairs(self, chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (block, rank of a vocabulary word in it), ascending, and each block's document. Blocks end at line feeds and documents."""
        if not len(chunk.hash):
            return (np.zeros(0, np.int64),) * 3
        at = np.searchsorted(self.by_hash, chunk.hash).clip(max=len(self.by_hash) - 1)
        hits = np.flatnonzero(self.by_hash[at] == chunk.hash)
        feeds = np.flatnonzero(chunk.data == 10)
        block = np.searchsorted(feeds, chunk.start[hits]) + chunk.owner[hits]  # a document's first line is another block than the last one's last
        found, first = np.unique(block * len(self.rank) + self.rank[at[hits]], return_index=True)
        return found // len(self.rank), found % len(self.rank), chunk.owner[hits[first]]

    def run_matches(self, chunk) -> Iterator[tuple[int, int, float]]:
        """(document, template, containment) of each document and template with a run of the template's length that matches: its best."""
        if not len(chunk.hash):
            return
        at = np.searchsorted(self.by_hash, chunk.hash).clip(max=len(self.by_hash) - 1)
        hits = np.flatnonzero(self.by_hash[at] == chunk.hash)
        rank, owner = self.rank[at[hits]], chunk.owner[hits]
        for t, (length, least) in enumerate(zip(self.lengths, self.least, strict=True)):
            kind = self.member[t, rank]
            if not (kind == 2).any():
                continue
            own = np.flatnonzero(kind)
            place, doc, word, rare = hits[own], owner[own], rank[own], np.append(0, np.cumsum(kind[own] == 2))
            # the run that ends at a hit holds the hits from `first` on; with repeats it has to hold enough of them already
            first, last = np.maximum(np.searchsorted(place, place - length, "right"), np.searchsorted(doc, doc)), np.arange(len(own))
            best: dict[int, int] = {}
            for k in np.flatnonzero((last - first + 1 >= least) & (rare[last + 1] > rare[first])).tolist():
                common = len(set(word[first[k] : k + 1].tolist()))
                if common >= least:
                    best[int(doc[k])] = max(best.get(int(doc[k]), 0), common)
            for d, common in best.items():
                yield d, t, common / len(self.sets[t])

    def matches(self, chunk) -> Iterator[tuple[int, int, float]]:
        """(document, template, containment) of each block and template that match."""
        block, rank, owner = self.pairs(chunk)
        if not len(block):
            return
        starts = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        stops = np.append(starts[1:], len(block))
        able = np.logical_or.reduceat(self.in_prefix[rank], starts)
        for a, b in zip(starts[able].tolist(), stops[able].tolist(), strict=True):
            own, tried = rank[a:b], set()
            for at, w in enumerate(own.tolist()):
                for t in self.prefix.get(w, ()):
                    if t in tried:
                        continue
                    tried.add(t)  # this is the first common word of the block and the template's prefix
                    words, least = self.sets[t], self.least[t]
                    behind = len(words) - 1 - int(np.searchsorted(words, w))
                    if len(own) < least or 1 + min(behind, len(own) - 1 - at) < least:
                        continue
                    common = int(np.isin(words, own, assume_unique=True).sum())
                    if common >= least:
                        yield int(owner[a]), t, common / len(words)


def _block_counts(docs: DataFrame, index: Index) -> dict[int, int]:
    """In how many blocks of all texts each template word stands. As many rows as the templates have words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.zeros(len(index.rank), np.int64)
            for chunk in tokens(batch.column(0), ALNUM, _VALUES):
                n += np.bincount(index.pairs(chunk)[1], minlength=len(n))
            yield pa.record_batch([pa.array(np.arange(len(n))), pa.array(n)], names=["rank", "n"])

    rows = docs.select("text").mapInArrow(work, "rank long, n long").groupBy("rank").agg(F.sum("n").alias("n")).collect()
    counts = {r["rank"]: r["n"] for r in rows}
    return {int(h): counts.get(int(r), 0) for h, r in zip(index.by_hash, index.rank, strict=True)}


def _phrase_places(chunk, phrases: list[tuple[np.ndarray, str]]) -> list[tuple[np.ndarray, str]]:
    out = []
    for hashes, label in phrases:
        at = np.flatnonzero(chunk.hash == hashes[0])
        at = at[at + len(hashes) <= chunk.ends[at]]
        for k in range(1, len(hashes)):
            at = at[chunk.hash[at + k] == hashes[k]]
        out.append((at, label))
    return out


_OUT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def template_table(templates: DataFrame) -> dict[str, str]:
    """Notice -> label of a table with columns text and label, of TEMPLATE_BYTES at most: it goes to every task."""
    rows = with_defaults(templates, text="string", label="string").where("text is not null and label is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > TEMPLATE_BYTES:
        raise ValueError(f"{size} bytes of templates; at most {TEMPLATE_BYTES} can be broadcast, scan for parts of the table")
    return {r["text"]: r["label"] for r in rows.distinct().orderBy("text", F.desc("label")).collect() if words_of(r["text"])}


def scan_licenses(docs: DataFrame, templates: dict[str, str] | DataFrame = TEMPLATES, phrases: dict[tuple[str, ...], str] = PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score per row of docs.

    n_base counts the places of all phrases, first_word and last_word are the least and the largest of their starts (null
    where there are none). labels holds the phrases' labels and those of matching templates. score is the largest
    containment of a match, 1 where a phrase stands, else 0. Templates may be a table (text, label). Null text has no words. Repeated rows and null ids stay as
    they are; extra columns are ignored; empty docs give an empty result.
    """
    texts = with_defaults(docs, doc_id="long", text="string")
    templates = templates if isinstance(templates, dict) else template_table(templates)
    index = Index(templates, threshold, _block_counts(texts, Index(templates, threshold)))
    sought = [(np.array([token_hash(w, _VALUES) for w in p], np.uint64), label) for p, label in phrases.items()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            words, places, first, last, score = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1), np.zeros(n)
            base: dict[int, set[str]] = {}
            more: dict[int, set[str]] = {}
            for chunk in tokens(batch.column(1), ALNUM, _VALUES):
                words[chunk.first : chunk.first + len(chunk.bounds) - 1] = np.diff(chunk.bounds)
                for at, label in _phrase_places(chunk, sought):
                    own = np.searchsorted(chunk.bounds, at, "right") - 1
                    start, row = at - chunk.bounds[own], own + chunk.first
                    np.add.at(places, row, 1)
                    np.minimum.at(first, row, start)
                    np.maximum.at(last, row, start)
                    for r in np.unique(row).tolist():
                        base.setdefault(r, set()).add(label)
                for d, t, share in chain(index.matches(chunk), index.run_matches(chunk)):
                    more.setdefault(chunk.first + d, set()).add(index.labels[t])
                    score[chunk.first + d] = max(score[chunk.first + d], share)
            score[places > 0] = 1.0
            none = places == 0
            names = lambda *sets: pa.array([",".join(sorted(set().union(*(s.get(i, ()) for s in sets)))) for i in range(n)], pa.string())
            yield pa.record_batch([batch.column(0), pa.array(words), pa.array(places), pa.array(first, mask=none), pa.array(last, mask=none), names(base), names(base, more), pa.array(score)], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return texts.mapInArrow(work, _OUT)


def oracle(templates: dict[str, str] = TEMPLATES, phrases: dict[tuple[str, ...], str] = PHRASES, threshold: float = THRESHOLD) -> str:
    """DuckDB SQL for scan_licenses() over the view documents."""
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    lower = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    notices = ", ".join("([" + ", ".join(f"'{w}'" for w in sorted(set(words_of(t)))) + f"], '{label}')" for t, label in templates.items())
    sought = " union all ".join(f"select id, i - 1 as start, '{label}' as label from places where " + " and ".join(f"w[i + {k}] = '{w}'" for k, w in enumerate(p)) for p, label in phrases.items())
    least = [(t, label, len(words_of(t)), sorted(set(words_of(t)))) for t, label in templates.items()]
    runs = " union all ".join(
        f"select id, '{label}' as label, count(distinct word) over (partition by id order by i range between {n - 1} preceding and current row) / {len(ws)} as share from hits where word in ("
        + ", ".join(f"'{w}'" for w in ws) + ")"
        for _, label, n, ws in least
    )
    every = ", ".join(f"'{w}'" for w in sorted({w for *_, ws in least for w in ws}))
    return f"""with rows as (select row_number() over () as id, doc_id, coalesce(text, '') as text from documents),
  split as (select id, doc_id, text, regexp_extract_all({lower("text")}, '{pattern}') as w from rows),
  places as (select id, w, unnest(range(1, len(w) + 1)) as i from split where w <> []),
  base as (select id, count(*) as n, min(start) as first_word, max(start) as last_word, list(distinct label) as labels from ({sought}) group by 1),
  blocks as (select id, list_distinct(regexp_extract_all({lower("line")}, '{pattern}')) as b from (select id, unnest(string_split(text, chr(10))) as line from rows)),
  notices as (select * from (values {notices}) v(t, label)),
  hits as materialized (select id, i, word from (select id, unnest(w) as word, unnest(range(1, len(w) + 1)) as i from split) where word in ({every})),
  matches as (select id, label, share from ({runs}) where share >= {threshold} - 1e-9 union all
    select id, label, len(list_intersect(t, b)) / len(t) as share from blocks, notices where len(b) > 0 and len(list_intersect(t, b)) >= {threshold} * len(t) - 1e-9),
  more as (select id, list(distinct label) as labels, max(share) as share from matches group by 1)
select doc_id, len(w)::bigint as n_words, coalesce(n, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
  coalesce(array_to_string(list_sort(base.labels), ','), '') as base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ','), '') as labels,
  case when n > 0 then 1.0 else coalesce(share, 0) end::double as score
from split left join base using (id) left join more using (id)"""
