"""Nearest-row search without forming pairs.

One dimension: both sides are put on one line and scanned once each way. More dimensions
under a weighted L1 distance on integer coordinates: every further axis is cut into dyadic
blocks, so that inside a block the sign of the difference is known and the search is a
running maximum again. Cost is rows x (bits/2) per further axis, whatever the group sizes.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dyadic import _inside, place, shr
from .pick import smallest
from .scan import Fold, cell_of, scan, stack


def neighbours(left: DataFrame, right: DataFrame, keys, x: str, right_id: str, width: int | None = None,
               payload: Sequence[str] = ()) -> DataFrame:
    """Left rows with the right row just at or before (`before`) and just after (`after`) them.

    x is an integer column on both sides. Right rows at one x are first reduced to the one
    with the smallest id, so copies cost nothing. `width` is the cell width of the scan.
    """
    keys = list(keys)
    if payload:
        r = right.groupBy(*keys, x).agg(F.min(F.struct(F.col(right_id).alias("id"), *[F.col(c) for c in payload])).alias("best"))
    else:  # a plain minimum aggregates by hashing
        r = right.groupBy(*keys, x).agg(F.min(right_id).alias("__rid")).select(*keys, x, F.struct(F.col("__rid").alias("id")).alias("best"))
    l = left.withColumn("__seq", F.lit(0))
    both, order = stack(l, r, keys, [F.col(x)], [F.col(x)], right_first=True)
    here = F.when(F.col("__r").isNotNull(), F.struct(F.col(f"__r.{x}").alias("x"), F.col("__r.best").alias("best")))
    cells = [cell_of("__o0", width)] if width else []
    out = scan(
        both, keys, [*order, "__side"],
        [Fold("before", "last", here), Fold("after", "first", here, inclusive=False)], cells,
    )
    return out.where(F.col("__l").isNotNull()).select("__l.*", "before", "after").drop("__seq")


def nearest_1d(left, right, keys, x: str, right_id: str, width: int | None = None, payload=(),
               max_gap: int | None = None, out="near") -> DataFrame:
    """Nearest right row per left row on an integer axis; ties go to the smaller id.

    Adds struct `out` (gap, id, payload); NULL when there is none or it is too far.
    """
    found = neighbours(left, right, keys, x, right_id, width, payload)

    def option(side, gap):
        return F.when(
            F.col(side).isNotNull(),
            F.struct(gap.alias("gap"), F.col(f"{side}.best.id").alias("id"),
                     *[F.col(f"{side}.best.{c}").alias(c) for c in payload]),
        )

    best = F.least(
        option("before", F.col(x) - F.col("before.x")), option("after", F.col("after.x") - F.col(x))
    )
    if max_gap is not None:
        best = F.when(best["gap"] <= max_gap, best)
    return found.withColumn(out, best).drop("before", "after")


@dataclass(frozen=True)
class Axis:
    """A further axis: integer columns in [0, 2**bits) and an integer weight per tick."""

    left: str
    right: str
    weight: int | str                  # a number, or a column that both sides hold and that is constant per key
    bits: int
    low_extra: Column | None = None    # added cost when the right row is at or below the left row
    high_extra: Column | None = None   # added cost when it is above
    equal_is_low: Column | None = None # which side an equal value counts to (default low)


def _axis_rows(df: DataFrame, i: int, bits: int, asking: bool) -> DataFrame:
    """Rows per side (0: right row low, 1: high) and block of axis i, with the block number __b{i}.

    An asking row names the blocks that together hold every tick on that side of it; a live
    row names the even blocks that hold it, which are the only ones ever asked for.
    """
    top, y, side, lv = (1 << bits) - 1, F.col(f"__y{i}"), F.col(f"__side{i}"), F.col("__lv")
    d = df.withColumn(f"__side{i}", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("__lv", F.explode(F.sequence(F.lit(0), F.lit(bits))))
    if asking:
        q = F.col(f"__q{i}").cast("bigint")
        d = d.withColumn("__m", F.when(side == 0, y + q).otherwise(top - y + 1 - q))
        d = d.where(shr(F.col("__m"), lv).bitwiseAND(F.lit(1)) == 1)
        cell = shr(F.col("__m"), lv) - 1
    else:
        d = d.withColumn("__m", F.when(side == 0, y).otherwise(top - y))
        d = d.where(shr(F.col("__m"), lv).bitwiseAND(F.lit(1)) == 0)
        cell = shr(F.col("__m"), lv)
    number = place(lv, cell, bits + 1)
    return d.withColumn(f"__b{i}", number * 2 + side).drop("__lv", "__m")


def nearest_l1(left: DataFrame, right: DataFrame, keys, left_id: str, right_id: str, lx: str, rx: str, wx: int | str,
               axes: Sequence[Axis] = (), width: int | None = None, out="near") -> DataFrame:
    """Nearest right row per left row under wx*|dx| + sum of weight*|d axis| (+ extras).

    Coordinates are integer ticks, so costs are exact; ties go to the smaller right id. A coordinate
    of a further axis outside [0, 2**bits) raises.
    Returns keys, left_id and struct out(cost, id) for left rows that have a right row.
    """
    keys = list(keys)
    def weight(w):
        return (F.col(w) if isinstance(w, str) else F.lit(w)).cast("bigint")

    weights = [weight(wx).alias("__wx"), *[weight(a.weight).alias(f"__wy{i}") for i, a in enumerate(axes)]]
    wnames = ["__wx", *[f"__wy{i}" for i in range(len(axes))]]
    l = left.select(*keys, *weights, F.col(left_id).alias("__id"), F.col(lx).cast("bigint").alias("__x"),
                    *[_inside(F.col(a.left), a.bits).alias(f"__y{i}") for i, a in enumerate(axes)],
                    *[(e if e is not None else F.lit(0)).cast("bigint").alias(f"__e{i}_{s}")
                      for i, a in enumerate(axes) for s, e in ((0, a.low_extra), (1, a.high_extra))],
                    *[(a.equal_is_low if a.equal_is_low is not None else F.lit(True)).alias(f"__q{i}")
                      for i, a in enumerate(axes)])
    r = right.select(*keys, *weights, F.col(right_id).alias("__id"), F.col(rx).cast("bigint").alias("__x"),
                     *[_inside(F.col(a.right), a.bits).alias(f"__y{i}") for i, a in enumerate(axes)])
    r = r.groupBy(*keys, *wnames, "__x", *[f"__y{i}" for i in range(len(axes))]).agg(F.min("__id").alias("__id"))
    lw, rw = F.lit(0).cast("bigint"), F.lit(0).cast("bigint")
    extra = F.lit(0).cast("bigint")
    blocks = []
    for i, a in enumerate(axes):
        y = F.col(f"__y{i}")
        l, r = _axis_rows(l, i, a.bits, True), _axis_rows(r, i, a.bits, False)
        sign = F.when(F.col(f"__side{i}") == 0, 1).otherwise(-1)
        lw = lw + sign * F.col(f"__wy{i}") * y
        rw = rw + sign * F.col(f"__wy{i}") * F.col(f"__y{i}")
        extra = extra + F.when(F.col(f"__side{i}") == 0, F.col(f"__e{i}_0")).otherwise(F.col(f"__e{i}_1"))
        blocks.append(f"__b{i}")
    wide = (F.col("__wx") * F.col("__x")).alias("__xx")
    l = l.select(*keys, *blocks, "__id", "__x", wide, lw.alias("__w"), extra.alias("__extra"))
    r = r.select(*keys, *blocks, "__id", "__x", wide, rw.alias("__w"))
    group = [*keys, *blocks]
    both, order = stack(l, r, group, [F.col("__x")], [F.col("__x")], right_first=True)
    is_r = F.col("__r").isNotNull()
    # left of the query: cost = (wx*lx + lw) - (wx*rx + rw); right of it: (lw - wx*lx) - (rw - wx*rx)
    back = F.when(is_r, F.struct((F.col("__r.__xx") + F.col("__r.__w")).alias("v"), (-F.col("__r.__id")).alias("n")))
    ahead = F.when(is_r, F.struct((F.col("__r.__xx") - F.col("__r.__w")).alias("v"), F.col("__r.__id").alias("n")))
    cells = [cell_of("__o0", width)] if width else []
    done = scan(both, group, [*order, "__side"],
                [Fold("__back", "max", back), Fold("__ahead", "rmin", ahead, inclusive=False)], cells)
    done = done.where(F.col("__l").isNotNull())
    base = F.col("__l.__extra")
    b = F.when(F.col("__back").isNotNull(), F.struct(
        (F.col("__l.__xx") + F.col("__l.__w") - F.col("__back.v") + base).alias("cost"), (-F.col("__back.n")).alias("id")))
    a = F.when(F.col("__ahead").isNotNull(), F.struct(
        (F.col("__ahead.v") - F.col("__l.__xx") + F.col("__l.__w") + base).alias("cost"), F.col("__ahead.n").alias("id")))
    per = done.select(*keys, F.col("__l.__id").alias(left_id), F.least(b, a).alias("__best")).where("__best is not null")
    best = smallest(per.select(*keys, left_id, F.col("__best.cost").alias("__cost"), F.col("__best.id").alias("__rid")), [*keys, left_id], "__cost", "__rid")
    return best.select(*keys, left_id, F.struct(F.col("__cost").alias("cost"), F.col("__rid").alias("id")).alias(out))
