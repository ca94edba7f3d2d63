"""Running aggregates over ordered rows, in bounded slices.

A window ``partitionBy(document).orderBy(line)`` sends a whole document to one
task, and one document (or user, or key) may hold a third of the data.  ``scan``
computes the same running values in two levels:

1. every group is cut into slices of ``chunk`` positions; ordinary windows run
   inside ``(group, slice)``, which never holds more than ``chunk`` rows;
2. one summary row per slice is aggregated, its running values over the earlier
   slices are taken, and they are joined back to the rows on ``(group, slice)``.

The rows are shuffled once, evenly; the summaries are ``1/chunk`` of them.  With
``chunk=None`` the caller states that every group fits one task, and one plain window
is used.

``stack`` computes running values that depend on each other, level by level, on the same
slices: rows stay where the first level put them, and every further level only moves its
summaries.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 1 << 16
SLICE = "_slice"


# Slice width in positions, a slice number that grows with the position, or None.
Chunk = int | Column | None


def slice_of(pos: str, chunk: int | Column) -> Column:
    return chunk if isinstance(chunk, Column) else F.floor(F.col(pos) / chunk).cast("long")


@dataclass(frozen=True)
class Frames:
    """Windows of one level: up to and including the row, before it, and the same
    two read from the end."""

    upto: Window
    before: Window
    onward: Window
    after: Window

    @staticmethod
    def over(keys: Sequence[str], pos: str) -> Frames:
        fwd = Window.partitionBy(*keys).orderBy(pos)
        back = Window.partitionBy(*keys).orderBy(F.col(pos).desc())
        first = Window.unboundedPreceding
        return Frames(
            fwd.rowsBetween(first, 0),
            fwd.rowsBetween(first, -1),
            back.rowsBetween(first, 0),
            back.rowsBetween(first, -1),
        )

    def pick(self, down: bool, inclusive: bool) -> Window:
        if down:
            return self.onward if inclusive else self.after
        return self.upto if inclusive else self.before


class Spec:
    """One running value.  ``local`` are stages of columns inside a slice,
    ``summary`` the aggregates kept per slice, ``carry`` stages over the earlier
    slices (``carried`` names what rows need of it), ``result`` the outputs.
    ``of_rows`` says that the summary reads what ``local`` has made."""

    of_rows = False

    def __init__(self, value: Column):
        self.value = value

    def local(self, n: str, f: Frames) -> list[dict[str, Column]]:
        raise NotImplementedError

    def summary(self, n: str, pos: str) -> dict[str, Column]:
        raise NotImplementedError

    def carry(self, n: str, f: Frames) -> list[dict[str, Column]]:
        raise NotImplementedError

    def carried(self, n: str) -> list[str]:
        return [f"{n}_c"]

    def result(self, n: str, carried: bool) -> dict[str, Column]:
        raise NotImplementedError


class Sum(Spec):
    """Running sum; ``down`` sums from the end."""

    def __init__(self, value: Column, *, down: bool = False, inclusive: bool = True):
        super().__init__(value.cast("long"))
        self.down, self.inclusive = down, inclusive

    def local(self, n, f):
        return [{f"{n}_l": F.sum(f"{n}_v").over(f.pick(self.down, self.inclusive))}]

    def summary(self, n, pos):
        return {f"{n}_s": F.sum(f"{n}_v")}

    def carry(self, n, f):
        return [{f"{n}_c": F.sum(f"{n}_s").over(f.pick(self.down, False))}]

    def result(self, n, carried):
        out = F.coalesce(F.col(f"{n}_l"), F.lit(0))
        return {n: out + F.coalesce(F.col(f"{n}_c"), F.lit(0)) if carried else out}


class Max(Spec):
    """Running maximum of the rows before (or up to) the row."""

    def __init__(self, value: Column, *, inclusive: bool = True):
        super().__init__(value)
        self.inclusive = inclusive

    def local(self, n, f):
        return [{f"{n}_l": F.max(f"{n}_v").over(f.pick(False, self.inclusive))}]

    def summary(self, n, pos):
        return {f"{n}_s": F.max(f"{n}_v")}

    def carry(self, n, f):
        return [{f"{n}_c": F.max(f"{n}_s").over(f.before)}]

    def result(self, n, carried):
        return {n: F.greatest(f"{n}_l", f"{n}_c") if carried else F.col(f"{n}_l")}


class Last(Spec):
    """Nearest non-NULL value before the row (``inclusive``: or on it); ``down``
    looks at the rows after it instead."""

    def __init__(self, value: Column, *, down: bool = False, inclusive: bool = True):
        super().__init__(value)
        self.down, self.inclusive = down, inclusive

    def local(self, n, f):
        win = f.pick(self.down, self.inclusive)
        return [{f"{n}_l": F.last(f"{n}_v", ignorenulls=True).over(win)}]

    def summary(self, n, pos):
        nearest = F.min_by if self.down else F.max_by
        return {f"{n}_s": nearest(f"{n}_v", F.when(F.col(f"{n}_v").isNotNull(), F.col(pos)))}

    def carry(self, n, f):
        win = f.pick(self.down, False)
        return [{f"{n}_c": F.last(f"{n}_s", ignorenulls=True).over(win)}]

    def result(self, n, carried):
        return {n: F.coalesce(f"{n}_l", f"{n}_c") if carried else F.col(f"{n}_l")}


class Since(Spec):
    """Rows since the nearest flagged row, which counts as 1; NULL where there is none.
    ``down`` counts to the next one instead."""

    of_rows = True

    def __init__(self, flag: Column, *, down: bool = False, inclusive: bool = True):
        super().__init__(flag)
        self.down, self.inclusive = down, inclusive

    def local(self, n, f):
        rows = F.count(F.lit(1)).over(f.pick(self.down, True))
        at = F.when(F.col(f"{n}_v"), F.col(f"{n}_r"))
        return [
            {f"{n}_r": rows},
            {f"{n}_l": F.max(at).over(f.pick(self.down, self.inclusive))},
        ]

    def summary(self, n, pos):
        return {f"{n}_s": F.count(F.lit(1)), f"{n}_m": F.max(F.when(F.col(f"{n}_v"), F.col(f"{n}_r")))}

    def carry(self, n, f):
        win = f.pick(self.down, False)
        before = F.coalesce(F.sum(f"{n}_s").over(win), F.lit(0))
        return [{f"{n}_b": before}, {f"{n}_c": F.col(f"{n}_b") - F.max(F.col(f"{n}_b") + F.col(f"{n}_m")).over(win)}]

    def result(self, n, carried):
        here = F.col(f"{n}_r") - F.col(f"{n}_l") + 1
        return {n: F.coalesce(here, F.col(f"{n}_r") + F.col(f"{n}_c") + 1) if carried else here}


class Runs(Spec):
    """How often the value has changed so far, NULLs skipped: output ``n`` is the
    number of changes up to the row, ``n_start`` the position where the current
    run of equal values began."""

    of_rows = True

    def __init__(self, value: Column, pos: str):
        super().__init__(value)
        self.pos = pos

    def local(self, n, f):
        v, prev, pos = F.col(f"{n}_v"), F.col(f"{n}_p"), F.col(self.pos)
        change = v.isNotNull() & prev.isNotNull() & (v != prev)
        opening = v.isNotNull() & prev.isNull()
        return [
            {f"{n}_p": F.last(f"{n}_v", ignorenulls=True).over(f.before)},
            {
                f"{n}_d": F.when(change, 1).otherwise(0),
                f"{n}_x": F.when(change, pos),
                f"{n}_o": F.when(opening, pos),
            },
            {
                f"{n}_l": F.sum(f"{n}_d").over(f.upto),
                f"{n}_b": F.last(f"{n}_x", ignorenulls=True).over(f.upto),
                f"{n}_f": F.last(f"{n}_o", ignorenulls=True).over(f.upto),
            },
        ]

    def summary(self, n, pos):
        v = F.col(f"{n}_v")
        at = F.when(v.isNotNull(), F.col(pos))
        return {
            f"{n}_sf": F.min_by(v, at),
            f"{n}_sl": F.max_by(v, at),
            f"{n}_sp": F.min(at),
            f"{n}_sn": F.sum(f"{n}_d"),
            f"{n}_sb": F.max(f"{n}_x"),
        }

    def carry(self, n, f):
        first, prev = F.col(f"{n}_sf"), F.col(f"{n}_cv")
        broke = first.isNotNull() & prev.isNotNull() & (first != prev)
        opened = first.isNotNull() & prev.isNull()
        return [
            {f"{n}_cv": F.last(f"{n}_sl", ignorenulls=True).over(f.before)},
            {
                f"{n}_cb": F.when(broke, 1).otherwise(0),
                f"{n}_co": F.when(broke | opened, 1).otherwise(0),
            },
            {
                f"{n}_ct": F.coalesce(
                    F.col(f"{n}_sb"), F.when(F.col(f"{n}_co") == 1, F.col(f"{n}_sp"))
                ),
            },
            {
                f"{n}_c": F.sum(F.col(f"{n}_sn") + F.col(f"{n}_cb")).over(f.before),
                f"{n}_cs": F.last(f"{n}_ct", ignorenulls=True).over(f.before),
            },
        ]

    def carried(self, n):
        return [f"{n}_c", f"{n}_cs", f"{n}_cb", f"{n}_co"]

    def result(self, n, carried):
        count, start, opening = F.col(f"{n}_l"), F.col(f"{n}_b"), F.col(f"{n}_f")
        if not carried:
            return {n: count, f"{n}_start": F.coalesce(start, opening)}
        broke = F.when(opening.isNotNull(), F.coalesce(F.col(f"{n}_cb"), F.lit(0))).otherwise(0)
        fresh = F.when(F.coalesce(F.col(f"{n}_co"), F.lit(1)) == 1, opening)
        return {
            n: count + broke + F.coalesce(F.col(f"{n}_c"), F.lit(0)),
            f"{n}_start": F.coalesce(start, fresh, F.col(f"{n}_cs")),
        }


def scan(
    df: DataFrame,
    by: Sequence[str],
    pos: str,
    specs: Mapping[str, Spec],
    chunk: Chunk = CHUNK,
) -> DataFrame:
    """Add the running values ``specs`` (name -> Spec) to ``df``.

    ``by`` are the non-NULL group columns and ``pos`` an integer column, unique
    inside a group, that orders it.  Any other orderable ``pos`` needs its slices
    spelled out: a ``chunk`` column that never falls as ``pos`` grows.
    """
    return stack(df, by, pos, [specs], chunk)


def stack(
    df: DataFrame,
    by: Sequence[str],
    pos: str,
    levels: Sequence[Mapping[str, Spec] | Callable[[DataFrame], DataFrame]],
    chunk: Chunk = CHUNK,
) -> DataFrame:
    """Several ``scan``s of one order over one exchange of the rows.

    A level is a mapping of specs, which may use the values of levels before it, or a
    function that derives columns or drops rows without moving any.  Slices that ``df``
    has from ``spread_join`` are used as they are.
    """
    sliced = chunk is not None
    keys = [*by, SLICE] if sliced else list(by)
    rows = df.withColumn(SLICE, slice_of(pos, chunk)) if sliced and SLICE not in df.columns else df
    first = True
    for level in levels:
        if callable(level):
            rows = level(rows)
            continue
        of_rows = not first or any(s.of_rows for s in level.values())
        rows = _level(rows, by, keys, pos, level, sliced, df.columns if of_rows else [])
        first = False
    return rows.drop(SLICE)


def _level(rows: DataFrame, by, keys, pos, specs: Mapping[str, Spec], sliced: bool, moved) -> DataFrame:
    columns = list(rows.columns)
    names = {out: f"_{i}" for i, out in enumerate(specs)}
    rows = rows.withColumns({f"{names[o]}_v": s.value for o, s in specs.items()})
    frames = Frames.over(keys, pos)
    rows = _stages(rows, [s.local(names[o], frames) for o, s in specs.items()])
    if sliced:
        # hashed, so that the rows keep their order for the next level
        carry = _carry(rows, by, keys, pos, specs, names, moved).hint("shuffle_hash")
        rows = rows.join(carry, keys)
    out: list[Column] = [F.col(c) for c in columns if c not in specs]
    for o, s in specs.items():
        for suffixed, col in s.result(names[o], sliced).items():
            out.append(col.alias(suffixed.replace(names[o], o, 1)))
    return rows.select(*out)


def _carry(rows, by, keys, pos, specs, names, moved) -> DataFrame:
    """What each slice inherits from the slices before (and after) it.

    Summaries that need values of single rows touch all columns that were ``moved``: their
    exchange is then the very one of the rows, which Spark reuses, instead of a second one
    of fewer columns.  Plain sums are added up before they are moved.
    """
    aggregates = [
        agg.alias(name)
        for o, s in specs.items()
        for name, agg in s.summary(names[o], pos).items()
    ]
    if moved:
        aggregates.append(F.bit_xor(F.xxhash64(*moved)).alias("_moved"))
    summary = rows.groupBy(*keys).agg(*aggregates)
    frames = Frames.over(list(by), SLICE)
    summary = _stages(summary, [s.carry(names[o], frames) for o, s in specs.items()])
    carried = [c for o, s in specs.items() for c in s.carried(names[o])]
    carry = summary.where(F.col("_moved").isNotNull()) if moved else summary
    return carry.select(*keys, *carried)


def _stages(df: DataFrame, per_spec: list[list[dict[str, Column]]]) -> DataFrame:
    """Add the columns stage by stage, all specs of a stage together, so that they
    share one sort."""
    for i in range(max(len(stages) for stages in per_spec)):
        stage: dict[str, Column] = {}
        for stages in per_spec:
            if i < len(stages):
                stage.update(stages[i])
        df = df.withColumns(stage)
    return df


def number_rows(
    df: DataFrame, by: Sequence[str], pos: str, name: str, chunk: Chunk = CHUNK
) -> DataFrame:
    """Add the 1-based rank of each row in its group, in ``pos`` order."""
    return scan(df, by, pos, {name: Sum(F.lit(1))}, chunk)


def spread_join(
    rows: DataFrame,
    per_group: DataFrame,
    by: Sequence[str],
    pos: str,
    chunk: Chunk = CHUNK,
    how: str = "left",
    within: Sequence[str] | None = None,
) -> DataFrame:
    """Join one row per group to the rows of the group.

    The small side is repeated for each slice of the group, so a group with a
    third of all rows is joined by many tasks.  ``within`` names a finer group whose
    slices are used and kept, so that a ``stack`` over it finds the rows in their places.
    """
    if chunk is None:
        return rows.join(per_group, list(by), how)
    keys = [*(within or by), SLICE]
    sliced = rows.withColumn(SLICE, slice_of(pos, chunk))
    slices = sliced.select(*keys).distinct().join(per_group, list(by), "inner")
    joined = sliced.join(slices.hint("shuffle_hash"), keys, how)
    return joined if within else joined.drop(SLICE)
