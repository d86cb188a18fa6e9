"""The k nearest points in the plane, found by descending through boxes.

Points are counted in square cells of doubling width, each with the tight box of its points. A
query starts at the whole plane. At every level its boxes are opened into those inside them; the farthest
corners of the boxes, with their counts, bound the k-th distance, and boxes whose nearest corner is beyond that
bound are dropped. What a query holds depends on k and on how many boxes touch the bound, not on how many points
its group has or how far away they are; a million points far from a query are a few boxes until the last levels.

Points at one coordinate are one box, of which the k smallest ids are kept. Points and queries without
coordinates have no result. Points at exactly the bound are all compared, so that ties are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle
from .dyadic import shr
from .nearest import Axis
from .ordering import top_k

#: A cell is opened into at most 4 ** STEP cells.
STEP = 3


def weighted_l1(wx: int, wy: int) -> Callable[[Column, Column], Column]:
    return lambda dx, dy: F.lit(wx) * dx + F.lit(wy) * dy


def squared(dx: Column, dy: Column) -> Column:
    return dx * dx + dy * dy


def _levels(spots: DataFrame, keys, origin) -> list[DataFrame]:
    """Boxes of each level, finest first: keys, cell __gx, __gy, the cell __px, __py around it, box and count."""
    x0, y0, x1, y1 = origin
    up = lambda c: shr(F.col(c), F.lit(STEP))
    at = spots.withColumns({"__gx": F.col("__x") - x0, "__gy": F.col("__y") - y0})
    out = [at.select(*keys, "__gx", "__gy", up("__gx").alias("__px"), up("__gy").alias("__py"), F.col("__x").alias("__x0"),
                     F.col("__x").alias("__x1"), F.col("__y").alias("__y0"), F.col("__y").alias("__y1"), "__n")]
    wide = max(x1 - x0, y1 - y0) >> STEP
    while wide:
        wide >>= STEP
        above = out[-1].groupBy(*keys, F.col("__px").alias("__gx"), F.col("__py").alias("__gy")).agg(
            F.min("__x0").alias("__x0"), F.max("__x1").alias("__x1"), F.min("__y0").alias("__y0"), F.max("__y1").alias("__y1"), F.sum("__n").alias("__n"))
        out.append(settle(above.withColumns({"__px": up("__gx"), "__py": up("__gy")})))
    return out


def k_nearest(rows: DataFrame, points: DataFrame, keys: Sequence[str], row_id: str, point_id: str, k: int,
              cost: Callable[[Column, Column], Column], x: str = "x", y: str = "y", ties: Sequence[str] = (), out: str = "cost") -> DataFrame:
    """k nearest points of each row: keys, row_id, rank, point_id, x, y of the point, cost.

    Coordinates are whole numbers; `cost` of the absolute differences along x and y rises with both. Ties go by the columns
    `ties` (x, y) and then by point_id. row_id is unique inside keys; keys hold no NULLs.
    """
    keys = list(keys)
    pts = points.select(*keys, F.col(point_id).alias("__id"), F.col(x).cast("bigint").alias("__x"), F.col(y).cast("bigint").alias("__y")).where("__x is not null and __y is not null")
    # a crowd at one coordinate is cut to k in every task before it is shuffled
    lists = settle(top_k(pts, [*keys, "__x", "__y"], [F.col("__id")], k).drop("rank"))
    spots = settle(lists.groupBy(*keys, "__x", "__y").agg(F.count(F.lit(1)).alias("__n")))
    origin = spots.agg(F.min("__x"), F.min("__y"), F.max("__x"), F.max("__y")).first()
    front = rows.select(*keys, row_id, F.col(x).cast("bigint").alias("__qx"), F.col(y).cast("bigint").alias("__qy")).where("__qx is not null and __qy is not null")
    front = front.withColumns({"__px": F.lit(0).cast("bigint"), "__py": F.lit(0).cast("bigint")})

    def apart(q, low, high):
        """Least and greatest difference between a coordinate and a range."""
        return F.greatest(F.lit(0), F.col(low) - F.col(q), F.col(q) - F.col(high)), F.greatest(F.abs(F.col(q) - F.col(low)), F.abs(F.col(q) - F.col(high)))

    mine = Window.partitionBy(*keys, row_id)
    for level in reversed(_levels(spots, keys, origin if origin[0] is not None else (0, 0, 0, 0))):
        near_x, far_x = apart("__qx", "__x0", "__x1")
        near_y, far_y = apart("__qy", "__y0", "__y1")
        f = front.join(level, [*keys, "__px", "__py"]).withColumns({"__near": cost(near_x, near_y), "__far": cost(far_x, far_y)})
        f = f.withColumn("__seen", F.sum("__n").over(mine.orderBy("__far", "__gx", "__gy").rowsBetween(Window.unboundedPreceding, 0)))
        bound = F.min(F.when(F.col("__seen") >= k, F.col("__far"))).over(mine)
        f = f.withColumn("__bound", bound).where("__bound is null or __near <= __bound")
        front = f.select(*keys, row_id, "__qx", "__qy", F.col("__gx").alias("__px"), F.col("__gy").alias("__py"), F.col("__x0").alias("__x"), F.col("__y0").alias("__y"), "__near")
    found = front.join(lists, [*keys, "__x", "__y"])
    named = {"x": "__x", "y": "__y"}
    best = top_k(found, [*keys, row_id], [F.col("__near"), *[F.col(named[t]) for t in ties], F.col("__id")], k)
    return best.select(*keys, row_id, "rank", F.col("__id").alias(point_id), F.col("__x").alias("point_x"), F.col("__y").alias("point_y"), F.col("__near").alias(out))


def nearest_lists(asks: DataFrame, live: DataFrame, keys: Sequence[str], ask_id: str, live_id: str, ax: str, lx: str, wx: int | str, axes: Sequence[Axis], k: int) -> DataFrame:
    """k nearest live rows of each asking row under wx*|dx| + sum of weight*|d axis| (+ extras): keys, ask_id, live_id, cost, rank.

    The same descent with any number of axes. Axes and weights are those of `nearest_l1`, seen from the asking side; weights and
    extras are constant per key. Ties go by live_id. Rows without all coordinates have no result. ask_id is unique inside keys.
    """
    keys, dims = list(keys), range(len(axes) + 1)
    step = max(1, 6 // len(dims))
    weight = lambda w: (F.col(w) if isinstance(w, str) else F.lit(w)).cast("bigint")
    given = lambda c, d: (c if c is not None else d)
    xs = [f"__c{i}" for i in dims]
    cells = [f"__g{i}" for i in dims]
    around = [f"__p{i}" for i in dims]
    whole = " and ".join(f"{c} is not null" for c in xs)
    pts = live.select(*keys, F.col(live_id).alias("__id"), *[F.col(c).cast("bigint").alias(xs[i]) for i, c in enumerate([lx, *[a.right for a in axes]])]).where(whole)
    lists = settle(top_k(pts, [*keys, *xs], [F.col("__id")], k).drop("rank"))
    spots = lists.groupBy(*keys, *xs).agg(F.count(F.lit(1)).alias("__n"))
    ends = lists.agg(*[F.min(c) for c in xs], *[F.max(c) for c in xs]).first()
    low = [v if v is not None else 0 for v in ends[:len(xs)]]
    wide = max((v if v is not None else 0) - o for v, o in zip(ends[len(xs):], low))
    up = lambda c: shr(F.col(c), F.lit(step))
    at = spots.withColumns({g: F.col(c) - o for g, c, o in zip(cells, xs, low)})
    levels = [settle(at.select(*keys, *cells, *[up(g).alias(q) for g, q in zip(cells, around)], *[F.col(c).alias(f"__lo{i}") for i, c in enumerate(xs)], *[F.col(c).alias(f"__hi{i}") for i, c in enumerate(xs)], "__n"))]
    while wide >> step:
        wide >>= step
        above = levels[-1].groupBy(*keys, *[F.col(q).alias(g) for g, q in zip(cells, around)]).agg(
            *[F.min(f"__lo{i}").alias(f"__lo{i}") for i in dims], *[F.max(f"__hi{i}").alias(f"__hi{i}") for i in dims], F.sum("__n").alias("__n"))
        levels.append(settle(above.withColumns({q: up(g) for g, q in zip(cells, around)})))
    asked = [weight(wx).alias("__w0")]
    for i, a in enumerate(axes, 1):
        asked += [weight(a.weight).alias(f"__w{i}"), given(a.low_extra, F.lit(0)).cast("bigint").alias(f"__a{i}"), given(a.high_extra, F.lit(0)).cast("bigint").alias(f"__b{i}"),
                  given(a.equal_is_low, F.lit(True)).alias(f"__e{i}")]
    places = [F.col(c).cast("bigint").alias(f"__q{i}") for i, c in enumerate([ax, *[a.left for a in axes]])]
    asks = asks.select(*keys, ask_id, *places, *asked).where(" and ".join(f"__q{i} is not null" for i in dims))
    own = [c for c in asks.columns if c not in keys]
    front = asks.withColumns({q: F.lit(0).cast("bigint") for q in around})
    near = far = F.lit(0).cast("bigint")
    for i in dims:
        q, lo, hi, w = F.col(f"__q{i}"), F.col(f"__lo{i}"), F.col(f"__hi{i}"), F.col(f"__w{i}")
        near = near + w * F.greatest(F.lit(0), lo - q, q - hi)
        far = far + w * F.greatest(F.abs(q - lo), F.abs(hi - q))
        if i and (axes[i - 1].low_extra is not None or axes[i - 1].high_extra is not None):
            even = F.col(f"__e{i}")
            under, over = F.when((lo < q) | ((lo == q) & even), F.col(f"__a{i}")), F.when((hi > q) | ((hi == q) & ~even), F.col(f"__b{i}"))
            near, far = near + F.coalesce(F.least(under, over), F.lit(0)), far + F.coalesce(F.greatest(under, over), F.lit(0))
    mine = Window.partitionBy(*keys, ask_id)
    for level in reversed(levels):
        f = front.join(level, [*keys, *around]).withColumns({"__near": near, "__far": far})
        f = f.withColumn("__seen", F.sum("__n").over(mine.orderBy("__far", *cells).rowsBetween(Window.unboundedPreceding, 0)))
        f = f.withColumn("__bound", F.min(F.when(F.col("__seen") >= k, F.col("__far"))).over(mine)).where("__bound is null or __near <= __bound")
        front = f.select(*keys, *own, *[F.col(g).alias(q) for g, q in zip(cells, around)], *[F.col(f"__lo{i}").alias(c) for i, c in enumerate(xs)], F.col("__near").alias("cost"))
        if level is not levels[0]:
            front = front.drop(*xs, "cost")
    found = front.select(*keys, ask_id, *xs, "cost").join(lists, [*keys, *xs])
    return top_k(found.select(*keys, ask_id, F.col("__id").alias(live_id), "cost"), [*keys, ask_id], [F.col("cost"), F.col(live_id)], k)
