"""Ordered computations over groups of any size.

A plain window puts a whole group on one task. Here every group is first cut into *cells*
(columns that grow with the order, such as the day of a timestamp). Each cell is folded on
its own, cells are summarised with an ordinary aggregation (partial sums before the
shuffle), the short list of cell summaries is folded per group, and the carried value is
joined back. One group may therefore spread over as many tasks as it has cells, and the
result is exactly that of the plain window.

Contract: `order` columns are ascending, without NULLs, and total within a group; `cells`
never decrease along `order`; `keys` hold no NULLs. An empty `cells` asks for the plain
window, for groups whose size is bounded by construction.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import rank_rows


@dataclass(frozen=True)
class Fold:
    """One running value.

    how: sum, count, max, min, last (latest non-NULL) run forward; first (next non-NULL),
    rsum, rcount, rmax, rmin run backward from the end of the group.
    """

    name: str
    how: str
    value: Column | None = None
    inclusive: bool = True

    @property
    def backward(self) -> bool:
        return self.how == "first" or self.how in ("rsum", "rcount", "rmax", "rmin")

    @property
    def kind(self) -> str:
        return "last" if self.how == "first" else self.how.lstrip("r") if self.backward else self.how


def cell_of(c, width: int) -> Column:
    """Cell number of an integer order column."""
    col = F.col(c) if isinstance(c, str) else c
    return F.floor(col / F.lit(width)).cast("bigint")


def _local(f: Fold, v: Column, w) -> Column:
    frame = w.rowsBetween(Window.unboundedPreceding, 0 if f.inclusive else -1)
    if f.kind in ("sum", "count"):
        return F.sum(v).over(frame)
    if f.kind == "last":
        return F.last(v, ignorenulls=True).over(frame)
    return getattr(F, f.kind)(v).over(frame)


def _merge(f: Fold, local: Column, carry: Column) -> Column:
    if f.kind in ("sum", "count"):
        return F.coalesce(local, F.lit(0)) + F.coalesce(carry, F.lit(0))
    if f.kind == "last":
        return F.coalesce(local, carry)
    return (F.greatest if f.kind == "max" else F.least)(local, carry)


def scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], folds: Sequence[Fold],
         cells: Sequence[Column] = ()) -> DataFrame:
    """Add the running values of `folds` to every row."""
    keys, order, folds = list(keys), list(order), list(folds)
    cell_names = [f"__c{i}" for i in range(len(cells))]
    values = {
        f"__v{i}": (F.lit(1) if f.kind == "count" else f.value) for i, f in enumerate(folds)
    }
    base = df.withColumns({**dict(zip(cell_names, cells)), **values})
    up = Window.partitionBy(*keys, *cell_names).orderBy(*order)
    down = Window.partitionBy(*keys, *cell_names).orderBy(*[F.col(o).desc() for o in order])
    local = base.withColumns(
        {f"__l{i}": _local(f, F.col(f"__v{i}"), down if f.backward else up) for i, f in enumerate(folds)}
    )
    if not cells:
        zero = [F.coalesce(F.col(f"__l{i}"), F.lit(0)) if f.kind in ("sum", "count") else F.col(f"__l{i}")
                for i, f in enumerate(folds)]
        return local.select(*df.columns, *[z.alias(f.name) for z, f in zip(zero, folds)])

    pos = F.struct(*order)
    aggs = []
    for i, f in enumerate(folds):
        v = F.col(f"__v{i}")
        if f.kind in ("sum", "count"):
            a = F.sum(v)
        elif f.kind == "last":
            pick = F.min_by if f.backward else F.max_by
            a = pick(v, F.when(v.isNotNull(), pos))
        else:
            a = getattr(F, f.kind)(v)
        aggs.append(a.alias(f"__s{i}"))
    summary = base.groupBy(*keys, *cell_names).agg(*aggs)
    cup = Window.partitionBy(*keys).orderBy(*cell_names).rowsBetween(Window.unboundedPreceding, -1)
    cdown = (
        Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in cell_names])
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = []
    for i, f in enumerate(folds):
        s, w = F.col(f"__s{i}"), cdown if f.backward else cup
        fn = F.last(s, ignorenulls=True) if f.kind == "last" else getattr(F, "sum" if f.kind == "count" else f.kind)(s)
        carried.append(fn.over(w).alias(f"__carry{i}"))
    on = keys + cell_names
    carry = summary.select(*[F.col(c).alias(f"__j_{c}") for c in on], *carried)
    cond = [F.col(c) == F.col(f"__j_{c}") for c in on]
    out = local.join(carry, cond, "left")
    return out.select(
        *df.columns,
        *[_merge(f, F.col(f"__l{i}"), F.col(f"__carry{i}")).alias(f.name) for i, f in enumerate(folds)],
    )


def number_rows(df, keys, order, out="rn", cells=()) -> DataFrame:
    """Exact row number per group; without keys over the whole table, by ranges of the order (cells are not needed)."""
    if not keys:
        return rank_rows(df, list(order), out)
    return scan(df, keys, order, [Fold(out, "count")], cells)


def shift(df, keys, order, cols: dict[str, Column], cells=(), ahead=False) -> DataFrame:
    """Value of the previous (or next) row, whole-row NULLs kept as NULL."""
    how = "first" if ahead else "last"
    names = list(cols)
    packed = F.struct(*[cols[n].alias(n) for n in names])
    out = scan(df, keys, order, [Fold("__shift", how, packed, inclusive=False)], cells)
    return out.select(*df.columns, *[F.col(f"__shift.{n}").alias(n) for n in names])


def stack(left: DataFrame, right: DataFrame, keys, left_order: Sequence[Column], right_order: Sequence[Column],
          right_first: bool = True) -> DataFrame:
    """Both sides in one ordered frame: keys, __o0.., __side, __l, __r (whole rows as structs)."""
    n = max(len(left_order), len(right_order))
    ltype, rtype = left.schema.simpleString(), right.schema.simpleString()

    def half(df, order, side, mine, other, other_type):
        cols = [F.col(k) for k in keys]
        cols += [c.alias(f"__o{i}") for i, c in enumerate(order)]
        return df.select(
            *cols, F.lit(side).alias("__side"),
            F.struct(*df.columns).alias(mine), F.lit(None).cast(other_type).alias(other),
        )

    l = half(left, left_order, 1 if right_first else 0, "__l", "__r", rtype)
    r = half(right, right_order, 0 if right_first else 1, "__r", "__l", ltype)
    return l.unionByName(r), [f"__o{i}" for i in range(n)]
