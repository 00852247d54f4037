r"""License scans by template-markup matching.

A template is a license's wording in which ``<<beginOptional>> ... <<endOptional>>`` marks what may be
left out (regions nest) and ``<<var;match=REGEX;words=MIN-MAX>>`` marks MIN to MAX words that each match
REGEX. It is compiled to an automaton over words; a text is accepted where the automaton takes
consecutive words of it from the first mandatory word to the last, so all wording that is neither
optional nor replaceable stands there exactly. Words are compared after A-Z is lower-cased.

The base rules find three phrases as consecutive words; the labels of accepted templates come on top.
score is 0 with nothing found, 0.5 with base phrases only, and 0.75 plus a quarter of the share of the
document's words that accepted regions cover once a template is accepted.

Each document is read whole, by itself: no shuffle. Templates are only tried on texts that hold their
longest mandatory word (a template of optional text alone: on all), from places where one of their first words stands.

Defined results: null and empty texts have no words, no labels and score 0; repeated rows give
repeated results; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common
from .license_texts import FULL

#: Base phrases and their labels (fixed values).
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Templates by label. The wording is the licenses' own.
TEMPLATES = {
    "mit": [
        "<<var;match=released|licensed|distributed|available|published;words=1-1>> under the <<beginOptional>>terms of the<<endOptional>> <<beginOptional>>expat<<endOptional>> mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and <<beginOptional>>its<<endOptional>> associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice <<beginOptional>>including the next paragraph<<endOptional>> shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall <<var;match=.*;words=1-20>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ],
    "apache-2.0": [
        "licensed under the apache license version 2 0 <<beginOptional>>the license you may not use this file except in compliance with the license<<endOptional>>",
        "<<var;match=released|distributed|available;words=1-1>> under the <<beginOptional>>terms of the<<endOptional>> apache license <<beginOptional>>version<<endOptional>> <<var;match=v?2;words=1-1>> 0",
    ],
    "gpl-2.0": ["<<beginOptional>>this work is<<endOptional>> licensed under the gnu general public license <<beginOptional>>version<<endOptional>> <<var;match=v?2;words=1-1>>"],
    "gpl-3.0": [
        "<<beginOptional>>this work is<<endOptional>> licensed under the gnu general public license <<beginOptional>>version<<endOptional>> <<var;match=v?3;words=1-1>>",
        "is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    ],
    "cc-by-4.0": ["licensed under <<beginOptional>>a creative commons<<endOptional>> <<beginOptional>>the<<endOptional>> cc by 4 0"],
    "cc-by-nc-4.0": ["licensed under <<beginOptional>>a creative commons<<endOptional>> <<beginOptional>>the<<endOptional>> cc by nc 4 0"],
    "isc": [
        "permission to use copy modify and <<beginOptional>>or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and <<var;match=.*;words=1-20>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall <<var;match=.*;words=1-20>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met <<beginOptional>>1<<endOptional>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer <<beginOptional>>2<<endOptional>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution <<beginOptional>><<beginOptional>>3<<endOptional>> neither the name of <<var;match=.*;words=1-20>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission<<endOptional>> this software is provided by <<var;match=.*;words=1-20>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall <<var;match=.*;words=1-20>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
    ],
}


def _add(label: str, *templates: str) -> None:
    TEMPLATES[label] = TEMPLATES.get(label, []) + list(templates)


for _label, _name, _version in [
    ("gpl-2.0", "general", "2"),
    ("gpl-3.0", "general", "3"),
    ("lgpl-2.0", "<<var;match=library|lesser;words=1-1>> general", "2"),
    ("lgpl-2.1", "lesser general", "2 1"),
    ("lgpl-3.0", "lesser general", "3"),
    ("agpl-3.0", "affero general", "3"),
]:
    _first, _, _rest = _version.partition(" ")
    _gnu, _by = f"gnu {_name} public license", "as published by the free software foundation"
    _add(
        _label,
        f"modify it under the terms of the {_gnu} {_by} either version {_version} of the license or at your option any later version",
        f"under the terms of the {_gnu} {_by} version {_version} of the license",
        f"under the terms of the {_gnu} version {_version} <<beginOptional>>only<<endOptional>> {_by}",
        f"under the terms of version {_version} of the {_gnu} <<beginOptional>>{_by}<<endOptional>>",
    )
    if _label in ("lgpl-2.1", "lgpl-3.0", "agpl-3.0"):
        _add(_label, f"<<var;match=released|licensed|distributed|available|published;words=1-1>> under the <<beginOptional>>terms of the<<endOptional>> {_gnu} <<beginOptional>>version<<endOptional>> <<var;match=v?{_first};words=1-1>> {_rest}")
_add("mpl-2.0", "subject to the terms of the mozilla public license <<var;match=v|version;words=1-1>> 2 0", "<<var;match=released|licensed|distributed|available|published;words=1-1>> under the <<beginOptional>>terms of the<<endOptional>> mozilla public license <<beginOptional>>version<<endOptional>> <<var;match=v?2;words=1-1>> 0")
for _label, _names in {
    "cc-by-4.0": [""],
    "cc-by-sa-4.0": ["sharealike", "share alike"],
    "cc-by-nd-4.0": ["noderivatives", "noderivs", "no derivatives"],
    "cc-by-nc-4.0": ["noncommercial", "non commercial"],
    "cc-by-nc-sa-4.0": ["noncommercial sharealike", "non commercial share alike"],
    "cc-by-nc-nd-4.0": ["noncommercial noderivatives", "noncommercial noderivs", "non commercial no derivatives"],
}.items():
    _add(_label, *(f"creative commons attribution {n} 4 0 international" for n in _names))
for _label, _text in FULL.items():
    _add(_label, _text)

_MARK = re.compile(r"<<(beginOptional|endOptional|var;match=(.*?);words=(\d+)-(\d+))>>")
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


@dataclass(frozen=True)
class Automaton:
    """steps[i] is (test, following states): test is a word, a pattern or None at the end."""

    label: str
    steps: tuple[tuple[bytes | re.Pattern | None, tuple[int, ...]], ...]
    begin: tuple[int, ...]
    needed: bytes

    def longest(self, words: list[bytes], at: int) -> int:
        """End of the longest run of words from ``at`` that is accepted, or ``at``."""
        live, end, i = set(self.begin), at, at
        while live:
            if any(self.steps[s][0] is None for s in live):
                end = i
            if i == len(words):
                break
            word = words[i]
            live = {t for s in live if self._takes(s, word) for t in self.steps[s][1]}
            i += 1
        return end

    def _takes(self, state: int, word: bytes) -> bool:
        test = self.steps[state][0]
        return test is not None and (test == word if isinstance(test, bytes) else test.fullmatch(word) is not None)

    def begins(self, word: bytes) -> bool:
        return any(self._takes(s, word) for s in self.begin)


def compiled(label: str, template: str) -> Automaton:
    """The automaton of a template: states take one word each, optional regions can be passed over."""
    tests: list = []
    follow: list[set[int]] = []

    def place(test) -> int:
        tests.append(test)
        follow.append(set())
        return len(tests) - 1

    # ends: states after which the next element may come (-1: the beginning)
    begin: set[int] = set()
    ends, marks, mandatory, depth, pos = {-1}, [], [], 0, 0

    def link(state: int) -> None:
        for e in ends:
            (begin if e < 0 else follow[e]).add(state)

    def literal(text: str) -> None:
        nonlocal ends
        for w in _WORD.findall(text.lower().encode()):
            state = place(w)
            link(state)
            ends = {state}
            if not depth:
                mandatory.append(w)

    for m in _MARK.finditer(template):
        literal(template[pos : m.start()])
        pos = m.end()
        if m[1] == "beginOptional":
            marks.append(set(ends))
            depth += 1
        elif m[1] == "endOptional":
            ends = ends | marks.pop()
            depth -= 1
        else:
            least, most, test = int(m[3]), int(m[4]), re.compile(m[2].encode())
            for k in range(most):
                before = set(ends)
                state = place(test)
                link(state)
                ends = {state} | (before if k >= least else set())
    literal(template[pos:])
    last = place(None)
    link(last)
    return Automaton(label, tuple((t, tuple(f)) for t, f in zip(tests, follow)), tuple(begin), max(mandatory, key=len, default=b""))


@lru_cache(maxsize=4)
def _automata(templates: tuple[tuple[str, str], ...]) -> tuple[Automaton, ...]:
    return tuple(compiled(label, t) for label, t in templates)


def scanned(text: bytes, automata: tuple[Automaton, ...]) -> dict | None:
    """What is found in a lower-cased text, or None if it holds no mandatory word at all."""
    tried = [a for a in automata if a.needed in text]
    if b"license" not in text and not tried:
        return None
    words = _WORD.findall(text)
    places, base = [], set()
    for i, w in enumerate(words):
        if w == b"license" and i:
            before = words[i - 1]
            if before in (b"mit", b"apache"):
                places.append(i - 1)
                base.add(PHRASES[f"{before.decode()} license"])
            elif before == b"public" and i > 1 and words[i - 2] == b"general":
                places.append(i - 2)
                base.add(PHRASES["general public license"])
    labels, inside = set(base), np.zeros(len(words), bool)
    for a in tried:
        i = 0
        while i < len(words):
            end = a.longest(words, i) if a.begins(words[i]) else i
            if end > i:
                labels.add(a.label)
                inside[i:end] = True
            i = max(end, i + 1)
    score = 0.75 + 0.25 * float(inside.mean()) if inside.any() else 0.5 * bool(places)
    return {"n_base": len(places), "first_word": min(places, default=None), "last_word": max(places, default=None), "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(labels)), "score": score}


_NOTHING = {"n_base": 0, "first_word": None, "last_word": None, "base_labels": "", "labels": "", "score": 0.0}
_SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def _scan(templates: tuple[tuple[str, str], ...]) -> Callable:
    def run(batches):
        automata = _automata(templates)
        for batch in batches:
            for part in common.slices(batch):
                texts = [(x or b"").lower() for x in part.column("text").cast(pa.binary()).to_pylist()]
                # a word begins where a character of one follows none; a zero byte parts the texts
                mask = _IN_WORD[np.frombuffer(b"\0" + b"\0".join(texts) + b"\0", np.uint8)]
                starts = np.concatenate([[0], np.cumsum(mask[1:] & ~mask[:-1])])
                ends = np.cumsum([len(x) + 1 for x in texts])
                n_words = starts[ends] - starts[np.r_[0, ends[:-1]]]
                found = [scanned(x, automata) or _NOTHING for x in texts]
                col = lambda c, t: pa.array([f[c] for f in found], t)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n_words, pa.int64()), *(col(c, pa.int64()) for c in ("n_base", "first_word", "last_word")), col("base_labels", pa.string()), col("labels", pa.string()), col("score", pa.float64())],
                    [x.split()[0] for x in _SCHEMA.split(", ")],
                )

    return run


def license_scan(docs: DataFrame, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """Base places and labels, the labels of accepted templates and the score, a row for each document."""
    pairs = tuple((label, t) for label, ts in (templates or TEMPLATES).items() for t in ts)
    return docs.select("doc_id", "text").mapInArrow(_scan(pairs), _SCHEMA)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(common.documents(spark, sf_dir))

