"""Seed and extend: repeated runs of units (words or lines) over a whole corpus.

1. Seeds: every document gives its winnowed anchors. Anchors found once cannot be part of a repeat, so
   their places go back to their documents and nothing more is made of them.
2. Positions of an anchor meet by its hash, each extended both ways at once: as far as any run that it
   stands for can reach, ``window - 1`` units to either side (less at the ends of a document). Places
   with the same anchor and the same extension are one class, represented by its first place. What lies
   inside a repeat falls into such classes: one row for each anchor, whatever the number of copies.
3. Only where places of an anchor differ in their extension - at the ends of maximal repeats - does the
   extension go unit by unit: the representatives give the runs of the threshold length around the
   anchor, a step to the left and to the right each, and equal ones meet by hash (128 bits).
4. Places to spare go back to their documents, which drop all other runs with a repeated anchor.
   Overlapping runs unite, so maximal repeats go as a whole.

All aggregates combine on the map side, so a run that a third of all documents share costs one row
a task, and no pair of documents is ever formed.

A text of more than ``stretch`` bytes goes through each step in stretches of its units. A stretch starts
and ends with as many units of its neighbours as a run has, which is as far as anything here depends on, so
the results are those of the whole text while a task holds the text and the units of one stretch.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, winnow

#: What becomes of the runs of a representative's anchor: all are spared; those are that no other place
#: (or no earlier one) has; none is. Of a long unit: it is spared.
ALL, SINGLE, NO, UNIT = range(4)


@dataclass(frozen=True)
class Repeats:
    """How to find repeats: ``units`` splits a text into the byte strings to be compared.

    A text may be cut at any ``separator`` into texts with the same units. ``kept(text, units, removed)``
    gives the parts that stay of it, to be joined by ``glue``.

    Runs of ``gram + window - 1`` units are the shortest repeats, and single units for which ``long``
    holds. With ``first_stays`` the first place of a repeat is kept.
    """

    units: Callable[[bytes], list[bytes]]
    kept: Callable[[bytes, list[bytes], np.ndarray], list[bytes]]
    separator: re.Pattern
    glue: bytes
    gram: int
    window: int
    first_stays: bool
    long: Callable[[bytes], bool] | None = None
    stretch: int = common.SLICE_BYTES

    @property
    def run(self) -> int:
        return self.gram + self.window - 1

    def marked(self, docs: DataFrame, finish: Callable, schema: list[tuple[str, str]]) -> DataFrame:
        """``finish(n, gone, texts)`` for each document of ``common.keyed``: how many units it has and loses, and
        what stays of it in pieces, to be joined by ``glue``.

        docs needs _k, _t, doc_id, text; further columns pass through to ``finish``'s row, whose
        columns ``schema`` names with their types.
        """
        key, place = ["_k", "_t"], "_k long, _t long, p int"
        gathered = lambda df, name, x="p": df.groupBy(*key).agg(F.collect_list(x).alias(name))
        any_place = [F.max(c).alias(c) for c in ("_k", "_t", "p")]  # of a single row, its own

        seeds = docs.select(*key, "text").mapInArrow(self._anchors(), f"{place}, h long").groupBy("h")
        once = gathered(seeds.agg(F.count("*").alias("n"), *any_place).where("n = 1"), "once")
        seeded = docs.join(once, key, "left")

        places = seeded.mapInArrow(self._extended(), f"{place}, h long, f1 long, f2 long, unit boolean")
        classes = places.groupBy("h", "f1", "f2", "unit").agg(F.count("*").alias("n"), F.min(F.struct("_k", "_t", "p")).alias("at"))
        # asking for a place as well lets both uses of the classes share one exchange
        of = lambda df, *keys: df.groupBy(*keys).agg(F.count("*").alias("classes"), F.max("at").alias("last")).where("last is not null").drop("last")
        if self.first_stays:
            others = of(classes, "h", "unit")
            mark = F.when(F.col("unit"), UNIT).when(F.col("classes") == 1, ALL).otherwise(SINGLE)
            marks = classes.join(others, ["h", "unit"]).select("at.*", mark.alias("mark"))
        else:
            alone = classes.where("n = 1")
            others = classes.where("n > 1").join(of(alone, "h"), "h", "left_semi")
            marks = alone.select("at.*", F.lit(SINGLE).alias("mark")).unionByName(others.select("at.*", F.lit(NO).alias("mark")))
        seeded = seeded.join(gathered(marks, "marks", F.struct("p", "mark")), key, "left")

        runs = seeded.mapInArrow(self._runs(), f"{place}, h1 long, h2 long, own boolean").groupBy("h1", "h2")
        if self.first_stays:
            spared = runs.agg(F.min(F.struct("_k", "_t", "p")).alias("at")).select("at.*")
        else:
            spared = runs.agg(F.count("*").alias("n"), F.max("own").alias("own"), *any_place).where("n = 1 and own")
        seeded = seeded.join(gathered(spared, "spared"), key, "left")
        return seeded.mapInArrow(self._finish(finish, [n for n, _ in schema]), ", ".join(f"`{n}` {kind}" for n, kind in schema))

    def _sliced(self, batches: Iterator[pa.RecordBatch]) -> Iterator[_Slice]:
        for batch in batches:
            for part in common.slices(batch, alone=self.stretch):
                yield from self._stretches(part, part.column("text").cast(pa.binary()).to_pylist())

    def _stretches(self, part: pa.RecordBatch, texts: list[bytes]) -> Iterator[_Slice]:
        """Whole documents together, or one long one in stretches."""
        if len(texts) != 1 or len(texts[0]) <= self.stretch:
            yield _Slice(part, self, [self.units(x) for x in texts])
            return
        held: list[bytes] = []
        first = done = 0  # places of the first unit held, and of the first that no stretch answers for
        rest = common.pieces(texts[0], self.separator, self.stretch)
        piece = next(rest)
        while piece is not None:
            held += self.units(piece)
            piece = next(rest, None)
            upto = first + len(held) - (0 if piece is None else self.run)
            if upto > done or piece is None:
                yield _Slice(part, self, [held], first, done - first, max(upto, done) - first)
                done = max(upto, done)
            drop = max(0, done - self.run - first)
            held, first = held[drop:], first + drop

    def _anchors(self) -> Callable:
        def run(batches):
            for s in self._sliced(batches):
                places = s.own(winnow.distinct(s.chosen))
                yield s.rows(places, {"h": s.grams[places]})

        return run

    def _extended(self) -> Callable:
        def run(batches):
            for s in self._sliced(batches):
                places = s.own(winnow.distinct(s.chosen[s.repeated]))
                reach = self.window - 1
                left, right = np.maximum(places - reach, s.begin[s.doc(places)]), np.minimum(places + self.gram + reach, s.ends[places] if len(places) else 0)
                shape = ((places - left) * self.window + right - places).astype(np.uint64)
                long = s.own(np.flatnonzero(s.long))
                none = np.zeros(len(long), np.uint64)
                columns = {"h": np.r_[s.grams[places], s.units[long]]}
                columns |= {f"f{i + 1}": np.r_[winnow.mixed(s.hashes[i].of(left, right) + shape), none] for i in (0, 1)}
                columns["unit"] = np.r_[np.zeros(len(places), bool), np.ones(len(long), bool)]
                yield s.rows(np.r_[places, long], columns)

        return run

    def _runs(self) -> Callable:
        def run(batches):
            for s in self._sliced(batches):
                mark = s.mark[s.chosen]
                kept = s.repeated & ((mark == SINGLE) | (mark == NO)) & s.owns(s.starts)
                starts = s.starts[kept]
                yield s.rows(starts, {f"h{i + 1}": s.hashes[i].of(starts, starts + self.run) for i in (0, 1)} | {"own": mark[kept] == SINGLE})

        return run

    def _finish(self, finish: Callable, names: list[str]) -> Callable:
        def row(text: bytes, units: list[bytes] | None, removed: np.ndarray) -> dict:
            return finish(len(removed), int(removed.sum()), self._left(text, units, removed))

        def run(batches):
            for batch in batches:
                for part in common.slices(batch, alone=self.stretch):
                    texts, removed = part.column("text").cast(pa.binary()).to_pylist(), []
                    for s in self._stretches(part, texts):
                        removed.append(s.removed(self.run)[s.core])
                    if s.whole:
                        rows = [row(text, units, removed[0][a : a + n]) for text, units, a, n in zip(texts, s.split, s.begin, s.lengths)]
                    else:
                        rows = [row(texts[0], None, np.concatenate(removed))]
                    yield finished(part, rows, names)

        return run

    def _left(self, text: bytes, units: list[bytes] | None, removed: np.ndarray) -> Iterator[bytes]:
        """What stays of a text, piece by piece; units that are not given are those of each piece."""
        at = 0
        for piece in common.pieces(text, self.separator, self.stretch) if units is None else (text,):
            some = self.units(piece) if units is None else units
            left = self.kept(piece, some, removed[at : at + len(some)])
            at += len(some)
            if left:
                yield self.glue.join(left)


class _Slice:
    """Documents of a task, or a stretch of one, with their units in one array and what earlier passes found in them.

    A stretch starts at the place ``first`` of its document and answers for its own places from ``begin`` to
    before ``end``.
    """

    def __init__(self, part: pa.RecordBatch, how: Repeats, split: list[list[bytes]], first: int = 0, begin: int | None = None, end: int = 0):
        self.part, self.split, self.first, self.whole = part, split, first, begin is None
        self.lengths = np.fromiter(map(len, split), np.int64, len(split))
        self.begin = np.cumsum(self.lengths) - self.lengths
        units = split[0] if len(split) == 1 else [u for x in split for u in x]
        self.core = slice(0, len(units)) if self.whole else slice(begin, end)
        self.units, self.ends = winnow.hashed(units), winnow.ends_of(self.lengths)
        self._long = lambda: np.fromiter(map(how.long, units), bool, len(units)) if how.long else np.zeros(len(units), bool)
        self.hashes = [winnow.Rolling(self.units, i) for i in (0, 1)]
        self.starts, self.chosen, self.grams = winnow.anchored(self.hashes[0], self.ends, how.gram, how.window)
        once = np.zeros(len(units) + 1, bool)
        once[self.listed("once")[0]] = True
        self.repeated = ~once[self.chosen]
        #: of the anchor at each place; NOTHING where a place represents no class
        self.mark = np.full(len(units) + 1, UNIT + 1, np.int8)
        self.kept_units = np.zeros(len(units), bool)
        at, mark = self.listed("marks", "p", "mark")
        self.kept_units[at[mark == UNIT]] = True
        self.mark[at[mark != UNIT]] = mark[mark != UNIT]

    def owns(self, places: np.ndarray) -> np.ndarray:
        return (places >= self.core.start) & (places < self.core.stop)

    def own(self, places: np.ndarray) -> np.ndarray:
        """Of ``places``, those that this stretch answers for."""
        return places if self.whole else places[self.owns(places)]

    def removed(self, run: int) -> np.ndarray:
        """Which units go, once all passes have been made."""
        hit = np.zeros(len(self.units) + 1, bool)
        hit[self.starts[self.repeated & (self.mark[self.chosen] != ALL)]] = True
        hit[self.listed("spared")[0]] = False
        return winnow.covered(len(self.units), np.flatnonzero(hit), run) | (self.long & ~self.kept_units)

    @cached_property
    def long(self) -> np.ndarray:
        return self._long()

    def listed(self, name: str, place: str | None = None, *more: str) -> tuple[np.ndarray, ...]:
        """The places in a column of lists (their field ``place``) as places in the slice, and further fields."""
        if name not in self.part.schema.names:
            return tuple(np.zeros(0, np.int64) for _ in (place, *more))
        column = self.part.column(name)
        values = column.flatten()
        fields = [(values if f is None else values.field(f)).to_numpy(zero_copy_only=False) for f in (place, *more)]
        counts = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        places = np.repeat(self.begin, counts) + fields[0] - self.first
        if self.whole:
            return places, *fields[1:]
        here = (places >= 0) & (places < len(self.units))
        return places[here], *(x[here] for x in fields[1:])

    def doc(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(np.cumsum(self.lengths), places, "right")

    def rows(self, places: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
        doc = self.doc(places)
        out = {c: self.part.column(c).to_numpy(zero_copy_only=False)[doc] for c in ("_k", "_t")}
        out["p"] = (places - self.begin[doc] + self.first).astype(np.int32) if len(places) else np.zeros(0, np.int32)
        out |= {c: x.view(np.int64) if x.dtype == np.uint64 else x for c, x in columns.items()}
        return pa.RecordBatch.from_arrays([pa.array(x) for x in out.values()], list(out))


def finished(part: pa.RecordBatch, rows: list[dict], names: list[str]) -> pa.RecordBatch:
    """A batch of the columns ``names``, from ``rows`` or else from ``part``."""
    made = rows[0].keys() if rows else ()
    kind = lambda n: pa.string() if isinstance(rows[0][n], bytes) else None
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kind(n)) if n in made else part.column(n) for n in names], names)
