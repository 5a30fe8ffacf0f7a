"""Folds: a row's output hangs on earlier output, so no window function fits.

``ordered_fold`` sorts the rows of each group within a partition and runs a fold object over
them, batch by batch and column by column: a task holds one state and one batch, however long
a group is.  Columns that a fold does not read pass through as they are, beside what it gives.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import repeat
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string


class Fold(Protocol):
    def add(self, *values) -> tuple | None:
        """What a row gives, of the columns that the fold reads; None for nothing."""

    def end(self) -> tuple | None:
        """What the end of a group gives, beside nulls for the columns that pass through."""


def ordered_fold(df: DataFrame, keys: Sequence[str], order: Sequence[str], new: Callable[[], Fold], reads: Sequence[str], schema: str, beside: Sequence[str] = ()) -> DataFrame:
    """(keys, ``beside``, what the folds give): ``new()`` starts a group, ``add`` takes the columns ``reads`` of its rows in order, ``end`` closes it."""
    own = StructType([df.schema[c] for c in (*keys, *beside)])
    shape = StructType([*own.fields, *_parse_datatype_string(schema).fields])
    arrow = to_arrow_schema(shape)
    made, width = arrow.types[len(own) :], len(keys)

    def batch(kept: list[pa.Array], rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else repeat((), len(made))
        return pa.RecordBatch.from_arrays([*kept, *(pa.array(c, t) for c, t in zip(columns, made, strict=True))], schema=arrow)

    def closing(key: tuple, fold: Fold) -> Iterator[pa.RecordBatch]:
        if (last := fold.end()) is not None:
            nulls = [pa.array([k], t) for k, t in zip(key, arrow.types, strict=False)] + [pa.nulls(1, t) for t in arrow.types[width : len(own)]]
            yield batch(nulls, [last])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, fold = None, None
        for b in batches:
            column = {c: b.column(b.schema.get_field_index(c)) for c in (*keys, *beside, *reads)}
            groups = zip(*(column[k].to_pylist() for k in keys), strict=True)
            values = zip(*(column[c].to_pylist() for c in reads), strict=True)
            places, rows = [], []

            def so_far(column=column, places=places, rows=rows) -> pa.RecordBatch:
                where = pa.array(places, pa.int32())
                return batch([column[c].take(where) for c in (*keys, *beside)], rows)

            for i, (key, row) in enumerate(zip(groups, values, strict=True)):
                if key != at or fold is None:
                    if fold is not None and (last := list(closing(at, fold))):
                        yield so_far()
                        yield from last
                        places.clear()
                        rows.clear()
                    at, fold = key, new()
                if (out := fold.add(*row)) is not None:
                    places.append(i)
                    rows.append(out)
            yield so_far()
        if fold is not None:
            yield from closing(at, fold)

    return df.select(*dict.fromkeys((*keys, *order, *reads, *beside))).repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, shape)


class Plain:
    """A fold whose groups end with nothing."""

    def end(self) -> None:
        return None


class Pack(Plain):
    """(i, begin, length) of notes (start, stop, limit in ticks): begin not before the last end, at least one tick long;
    what would end past ``limit`` is left out and moves nothing."""

    def __init__(self) -> None:
        self.last = self.i = 0

    def add(self, start: int, stop: int, limit: int | None = None) -> tuple | None:
        begin = max(self.last, start)
        stop = max(stop, begin + 1)
        self.i += 1
        if limit is not None and stop > limit:
            return None
        self.last = stop
        return self.i, begin, stop - begin


class Breaks(Plain):
    """(i, at) of notes (begin, length, phrase, chars): ``at`` is the tick of a line break before the note, or null.

    A line ends when the phrase changes, when it has ``most`` characters, or before
    a rest of ``gap`` ticks; its characters are counted anew after a break.
    """

    def __init__(self, most: int = 42, gap: int = 20) -> None:
        self.most, self.gap = most, gap
        self.count = self.i = 0
        self.phrase = self.finish = None

    def add(self, begin: int, length: int, phrase, chars: int) -> tuple:
        at = None
        if self.i and (phrase != self.phrase or self.count >= self.most or begin - self.finish >= self.gap):
            at, self.count = self.finish, 0
        self.count += chars
        self.phrase, self.finish, self.i = phrase, begin + length, self.i + 1
        return self.i, at


class Layout(Plain):
    """(k, begin, length, cut) of notes (start, stop, limit, phrase, chars): packed, and the placed ones broken into lines."""

    def __init__(self) -> None:
        self.pack, self.breaks = Pack(), Breaks()

    def add(self, start: int, stop: int, limit: int | None, phrase, chars: int) -> tuple | None:
        put = self.pack.add(start, stop, limit)
        if put is None:
            return None
        k, cut = self.breaks.add(put[1], put[2], phrase, chars)
        return k, put[1], put[2], cut


class Hysteresis:
    """(i, state) of observations (seen, long, first): the state starts as the vote's winner ``first`` and changes where two long
    observations in a row agree on another one; the first of the two then belongs to the new state."""

    def __init__(self) -> None:
        self.state = self.seen = self.long = self.held = None
        self.i = 0

    def add(self, seen, long, first) -> tuple | None:
        if self.i == 0:
            self.state = first
        elif seen is not None and self.seen == seen != self.state and self.long and long:
            self.state = self.held = seen
        out = (self.i, self.held) if self.i else None
        self.seen, self.long, self.held, self.i = seen, long, self.state, self.i + 1
        return out

    def end(self) -> tuple | None:
        return (self.i, self.held) if self.i else None


class Windows:
    """(i, core_start, core_end) over a track of levels (at: 0, 1, 2, ...; level): a core runs on to the quietest step
    between ``least`` and ``most`` after its start, the first of equals; the last one to the end."""

    def __init__(self, least: int = 22, most: int = 26) -> None:
        self.least, self.most = least, most
        self.begin = self.i = self.n = 0
        self.levels: list[float] = []

    def add(self, level: float) -> tuple | None:
        self.levels.append(level)
        self.n += 1
        if self.n - self.begin <= self.most:
            return None
        near = self.levels[self.least : self.most + 1]
        cut = self.begin + self.least + min(range(len(near)), key=near.__getitem__)
        out = (self.i, self.begin, cut)
        self.levels, self.begin, self.i = self.levels[cut - self.begin :], cut, self.i + 1
        return out

    def end(self) -> tuple | None:
        return (self.i, self.begin, self.n) if self.n > self.begin else None
