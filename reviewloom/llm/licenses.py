"""License scans by template markup.

A template is wording in words, with marked regions::

    <<beginOptional>> .. <<endOptional>>          these words may be absent
    <<var;name=holder;words=0-12>>                any 0 to 12 words
    <<var;name=nc;match=noncommercial|non commercial>>   one of these wordings

All templates compile into one automaton over words. A text is accepted from a word on if the mandatory wording of a template
stands there exactly, word by word, with optional regions present or absent and replaceable ones filled as marked.
Templates begin with two mandatory words, so only places with such a pair of words are followed further.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.common import LOWER_ASCII, span_hashes, texts

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes between words, after A-Z are lower-cased.
GAP = np.zeros(256, bool)
GAP[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
#: Followed sets of states that are remembered at most; then the memory starts anew.
REMEMBERED = 1 << 16


class Template(NamedTuple):
    label: str
    wording: str
    base: bool = False


#: The phrases whose places are counted, with their labels.
BASE = (
    Template("mit", "under the mit license", True),
    Template("apache-2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", True),
)

#: Wording of public licenses and of their usual notices.
NOTICES = (
    Template("mit", """
        permission is hereby granted free of charge to any person obtaining a copy of this software and associated
        documentation files the software to deal in the software without restriction including without limitation the
        rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit
        persons to whom the software is furnished to do so subject to the following conditions the above copyright
        notice and this permission notice <<beginOptional>>including the next paragraph<<endOptional>> shall be included
        in all copies or substantial portions of the software"""),
    Template("apache-2", """
        licensed under the apache license version 2 0 <<beginOptional>>the license<<endOptional>> you may not use this
        <<var;name=work;words=1-3>> except in compliance with the license you may obtain a copy of the license at"""),
    Template("isc", """
        permission to use copy modify and or distribute this software for any purpose with or without fee is hereby
        granted provided that the above copyright notice and this permission notice appear in all copies"""),
    Template("bsd", """
        redistribution and use in source and binary forms with or without modification are permitted provided that the
        following conditions are met <<var;name=mark;words=0-1>> redistributions of source code must retain the above
        copyright notice this list of conditions and the following disclaimer"""),
    Template("gpl", """
        gnu general public license <<beginOptional>>as published by the free software foundation<<endOptional>>
        <<beginOptional>>either<<endOptional>> <<var;name=version;match=version 2|version 3|v2|v3>>"""),
    Template("lgpl", """
        gnu lesser general public license <<beginOptional>>as published by the free software foundation<<endOptional>>
        <<beginOptional>>either<<endOptional>> <<var;name=version;match=version 2|version 3|v2|v3>>"""),
    Template("mpl-2", """
        subject to the terms of the mozilla public license <<beginOptional>>v<<endOptional>>
        <<beginOptional>>version<<endOptional>> 2 0"""),
    Template("cc-by", """
        creative commons attribution <<var;name=version;words=0-1>> <<beginOptional>>0<<endOptional>>
        <<var;name=scope;match=international|unported|generic>> <<beginOptional>>public<<endOptional>> license"""),
    Template("cc-by-nc", "creative commons attribution <<var;name=nc;match=noncommercial|non commercial>>"),
    Template("cc-by-sa", "creative commons attribution <<var;name=sa;match=sharealike|share alike>>"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
)

_MARK = re.compile(r"<<\s*(beginOptional|endOptional|var)\s*(?:;([^>]*))?>>")
_CLASS = re.compile(WORD)


def _said(text: str) -> list[str]:
    return _CLASS.findall(re.sub("[A-Z]+", lambda m: m.group().lower(), text))


def parse(wording: str) -> list:
    """Wording as a list of words, ``("optional", list)``, ``("words", least, most)`` and ``("match", [list, ..])``."""
    out: list = []
    open_ones = [out]
    at = 0
    for mark in _MARK.finditer(wording):
        open_ones[-1] += _said(wording[at:mark.start()])
        at = mark.end()
        if mark[1] == "beginOptional":
            inner: list = []
            open_ones[-1].append(("optional", inner))
            open_ones.append(inner)
        elif mark[1] == "endOptional":
            open_ones.pop()
            if not open_ones:
                raise ValueError("endOptional without beginOptional")
        else:
            given = dict(p.split("=", 1) for p in (mark[2] or "").split(";") if "=" in p)
            if "match" in given:
                open_ones[-1].append(("match", [_said(m) for m in given["match"].split("|")]))
            elif "words" in given:
                least, most = map(int, given["words"].split("-"))
                open_ones[-1].append(("words", least, most))
            else:
                raise ValueError(f"a replaceable region needs words or match: {mark[0]}")
    if len(open_ones) > 1:
        raise ValueError("beginOptional without endOptional")
    open_ones[-1] += _said(wording[at:])
    if len(out) < 2 or not all(isinstance(x, str) for x in out[:2]):
        raise ValueError("a template begins with two mandatory words")
    return out


def mandatory(items: list) -> int:
    """Number of words that every accepted text has."""
    return sum(1 if isinstance(x, str) else 0 if x[0] == "optional" else x[1] if x[0] == "words" else
               min(map(len, x[1])) for x in items)


def as_regex(wording: str) -> str:
    """The same wording as a regular expression over words joined by single spaces; each word brings its space before it."""
    def write(items: list) -> str:
        out = ""
        for x in items:
            if isinstance(x, str):
                out += " " + re.escape(x)
            elif x[0] == "optional":
                out += f"(?:{write(x[1])})?"
            elif x[0] == "words":
                out += f"(?: [^ ]+){{{x[1]},{x[2]}}}"
            else:
                out += "(?:" + "|".join(write(m) for m in x[1]) + ")"
        return out

    return write(parse(wording)) + "(?: |$)"


class Automaton:
    """All templates as one automaton; sets of its states are followed and remembered as they occur."""

    def __init__(self, templates: Iterable[Template]):
        self.templates = list(templates)
        self.steps: list[list[tuple[int, int]]] = []  # by state: (word, to); word 0 is any word
        self.free: list[list[int]] = []  # by state: states reached without a word
        self.accepts: dict[int, int] = {}
        self.words: dict[str, int] = {}
        pairs, starts = set(), []
        for number, template in enumerate(self.templates):
            items = parse(template.wording)
            start = self._state()
            self.accepts[self._add(items, start)] = number
            starts.append(start)
            pairs.add((self.words[items[0]], self.words[items[1]]))
        many = len(self.words) + 1
        self.pair = np.zeros((many, many), bool)
        for a, b in pairs:
            self.pair[a, b] = True
        spelled = [w.encode() for w in self.words]
        ends = np.cumsum([len(w) for w in spelled])
        hashes = span_hashes(np.frombuffer(b"".join(spelled), np.uint8), ends - [len(w) for w in spelled], ends)
        order = np.argsort(hashes)
        self.hashes, self.numbers = hashes[order], np.array(list(self.words.values()))[order]
        self.start = self._close(starts)
        self.known: dict[tuple[frozenset, int], tuple[frozenset, tuple[int, ...]]] = {}

    def _state(self) -> int:
        self.steps.append([])
        self.free.append([])
        return len(self.steps) - 1

    def _add(self, items: list, at: int) -> int:
        for x in items:
            to = self._state()
            if isinstance(x, str):
                self.steps[at].append((self.words.setdefault(x, len(self.words) + 1), to))
            elif x[0] == "optional":
                self.free[at].append(to)
                self.free[self._add(x[1], at)].append(to)
            elif x[0] == "match":
                for choice in x[1]:
                    begin = self._state()
                    self.free[at].append(begin)
                    self.free[self._add(choice, begin)].append(to)
            else:
                for k in range(x[2]):
                    if k >= x[1]:
                        self.free[at].append(to)
                    following = self._state()
                    self.steps[at].append((0, following))
                    at = following
                self.free[at].append(to)
            at = to
        return at

    def _close(self, states: Iterable[int]) -> frozenset:
        seen, left = set(states), list(states)
        while left:
            for to in self.free[left.pop()]:
                if to not in seen:
                    seen.add(to)
                    left.append(to)
        return frozenset(seen)

    def numbered(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of the words with these hashes; 0 for words of no template."""
        if not len(hashes):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.numbers[at], 0)

    def follow(self, said: np.ndarray, at: int, to: int) -> dict[int, int]:
        """Templates accepted from word ``at`` on, with the end of the longest acceptance; no word from ``to`` on is read."""
        found: dict[int, int] = {}
        states = self.start
        for k in range(at, to):
            key = (states, int(said[k]))
            got = self.known.get(key)
            if got is None:
                reached = self._close({t for s in states for w, t in self.steps[s] if w == key[1] or w == 0})
                got = reached, tuple(self.accepts[s] for s in reached if s in self.accepts)
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[key] = got
            states = got[0]
            for number in got[1]:
                found[number] = k + 1
            if not states:
                break
        return found


MATCH = "array<struct<template:int,first:long,last:long>>"


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: Iterable[Template] = BASE + NOTICES) -> DataFrame:
    """``(key, n_words, matches)``: for every row the accepted places, by first word (from 0) and template.

    ``last`` is the last word of the longest acceptance from ``first``. Null and empty texts have no words and no
    matches; repeated rows stay; other columns are left out; an empty table gives no rows.
    """
    templates = tuple(templates)
    kind = docs.schema[key].dataType.simpleString()
    shape = pa.list_(pa.struct([("template", pa.int32()), ("first", pa.int64()), ("last", pa.int64())]))

    def find(batches):
        automaton = Automaton(templates)
        for batch in batches:
            n_words, matches = [], []
            for part in texts(batch.column(1), LOWER_ASCII, GAP):
                said = automaton.numbered(span_hashes(part.data, part.begins, part.ends))
                begin = np.flatnonzero(automaton.pair[said[:-1], said[1:]]) if len(said) > 1 else np.zeros(0, np.int64)
                row = np.searchsorted(part.first, begin, "right") - 1
                found = [[] for _ in part.rows]
                for at, r in zip(begin.tolist(), row.tolist()):
                    for number, end in sorted(automaton.follow(said, at, int(part.first[r + 1])).items()):
                        found[r].append({"template": number, "first": at - int(part.first[r]), "last": end - 1 - int(part.first[r])})
                n_words += np.diff(part.first).tolist()
                matches += found
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(matches, shape)],
                                             names=[key, "n_words", "matches"])

    return docs.select(key, text).mapInArrow(find, f"`{key}` {kind}, n_words long, matches {MATCH}")


def summary(scanned: DataFrame, templates: Iterable[Template] = BASE + NOTICES) -> DataFrame:
    """Counts and labels from the matches of :func:`scan`.

    ``n_base`` counts the places of base phrases, ``first_word`` and ``last_word`` are their smallest and largest start;
    labels are distinct, sorted and comma-joined. ``score`` is ``1 - 1 / (1 + m)`` with ``m`` the mandatory words of the longest
    wording accepted, 0 without any.
    """
    templates = list(templates)
    label = F.array(*[F.lit(t.label) for t in templates])
    base = F.array(*[F.lit(t.base) for t in templates])
    sure = F.array(*[F.lit(1 - 1 / (1 + mandatory(parse(t.wording)))) for t in templates])
    counted = F.filter("matches", lambda m: F.get(base, m["template"]))

    def labels(of):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(of, lambda m: F.get(label, m["template"])))), ",")

    return scanned.withColumn("__base", counted).select(
        *[c for c in scanned.columns if c != "matches"], F.size("__base").cast("long").alias("n_base"),
        F.array_min(F.transform("__base", lambda m: m["first"])).alias("first_word"),
        F.array_max(F.transform("__base", lambda m: m["first"])).alias("last_word"),
        labels(F.col("__base")).alias("base_labels"), labels(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: F.get(sure, m["template"]))), F.lit(0.0)).alias("score"))
