"""Distributed order statistics: running totals, exact percentiles, md5 ranks.

None of these uses a window without a partition key over the whole input.
Ordered work is done in two levels:

1. rows are cut into range buckets (boundaries from a bounded-memory
   ``percentile_approx`` sketch, or a prefix of an md5 hash),
2. per-bucket totals form a small table whose cumulative offsets are
   broadcast back, and the window runs *inside* each bucket only.

A hot value never lands in one task: percentiles and rank metrics first
collapse equal values into ``(value, count)`` rows with a map-side combine.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskspark.operators.columns import col, join_null_safe, num
from riskspark.session import materialize

#: rows handled by one bucket of a two-level window
ROWS_PER_BUCKET = 2_000_000
#: percentiles: rows that one bracket may hold when it is ranked
BRACKET_ROWS = 100_000
#: percentiles: places that a narrowing round parts a bracket into
PLACES = 4096
#: doubles are told apart in fewer rounds (but for some next to the smallest); what is left is ranked
MAX_ROUNDS = 12
#: largest table of a few numbers per row that we broadcast; checked every time
BROADCAST_ROW_LIMIT = 100_000


def _bucket_count(n: int, rows_per_bucket: int) -> int:
    return int(max(1, math.ceil(n / max(1, rows_per_bucket))))


def range_buckets(df: DataFrame, column: str, n_rows: int | None = None,
                  rows_per_bucket: int = ROWS_PER_BUCKET, out: str = "_bucket") -> DataFrame:
    """Add an integer range-bucket column monotone in ``column``.

    Boundaries come from one ``percentile_approx`` sketch (bounded memory);
    balance is approximate, correctness does not depend on it.
    """
    if n_rows is None:
        n_rows = df.count()
    b = _bucket_count(n_rows, rows_per_bucket)
    if b <= 1:
        return df.withColumn(out, F.lit(0))
    qs = [i / b for i in range(1, b)]
    acc = max(10_000, 4 * b)  # sketch resolution finer than the bucket width
    bounds = df.agg(F.percentile_approx(F.col(column).cast("double"), qs, acc).alias("b")).first()["b"] or []
    splits = sorted({float(x) for x in bounds if x is not None and not math.isnan(x)})
    if not splits:
        return df.withColumn(out, F.lit(0))
    splits = [-math.inf] + splits + [math.inf]
    tmp = "_bucket_src"
    bz = Bucketizer(splits=splits, inputCol=tmp, outputCol=out, handleInvalid="keep")
    res = bz.transform(df.withColumn(tmp, F.col(column).cast("double")))
    return res.withColumn(out, F.col(out).cast("int")).drop(tmp)


def _safe_broadcast(small: DataFrame, n_rows: int) -> DataFrame:
    return F.broadcast(small) if n_rows <= BROADCAST_ROW_LIMIT else small


def running_totals(df: DataFrame, order_col: str, sums: Sequence[str], by: Sequence[str] = (),
                   descending: bool = False, rows_per_bucket: int = ROWS_PER_BUCKET,
                   n_rows: int | None = None, n_groups: int = 1) -> DataFrame:
    """Add ``cum_<s>``: inclusive running sum of each ``s`` in ``order_col`` order
    within each ``by`` group. ``order_col`` should be unique per group
    (pre-aggregate equal values first); ties are otherwise broken arbitrarily.
    """
    by = list(by)
    if n_rows is None:
        n_rows = df.count()
    bdf = range_buckets(df, order_col, n_rows, rows_per_bucket)
    order = F.col(order_col).desc() if descending else F.col(order_col).asc()
    border = F.col("_bucket").desc() if descending else F.col("_bucket").asc()
    tot = bdf.groupBy(*by, "_bucket").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    wprev = Window.partitionBy(*by).orderBy(border).rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select(*by, "_bucket", *[
        F.coalesce(F.sum(f"_t_{s}").over(wprev), F.lit(0)).alias(f"_o_{s}") for s in sums])
    n_off = _bucket_count(n_rows, rows_per_bucket) * max(1, n_groups)
    joined = join_null_safe(bdf, _safe_broadcast(off, n_off), by + ["_bucket"])
    w = Window.partitionBy(*by, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = joined
    for s in sums:
        out = out.withColumn(f"cum_{s}", F.col(f"_o_{s}") + F.sum(s).over(w))
    return out.drop("_bucket", *[f"_o_{s}" for s in sums])


# ---------------------------------------------------------------- percentiles

def _magnitude(x: Column) -> Column:
    """Rises with ``x`` over all finite doubles, by its logarithm on both sides of zero."""
    return F.when(x == 0, F.lit(0.0)).otherwise(F.signum(x) * (F.log(F.abs(x)) + F.lit(746.0)))


def _with_place(placed: DataFrame, out: str) -> DataFrame:
    """Add the value's place in its bracket ``[_a, _b]``: the sum of its place by distance
    and its place by magnitude. Both rise with the value, so the sum does, and parts a
    bracket as finely as the finer one, whatever the distribution. Infinite values have
    places of their own; the ends of a bracket of two values or more never share one."""
    v = F.col("_v")
    own = (v * F.col("_k") - F.col("_a")) * F.col("_by_distance") + (_magnitude(v) - F.col("_m")) * F.col("_by_magnitude")
    # another group's values may lie beyond the bracket; nobody asks for their places
    own = F.floor(F.greatest(F.least(own, F.lit(float(PLACES))), F.lit(0.0)))
    return (placed.withColumn(out, F.when(v == F.lit(-math.inf), F.lit(-1)).when(v == F.lit(math.inf), F.lit(PLACES + 1)).otherwise(own).cast("int"))
            .drop(*_SPAN))


_SPAN = ("_k", "_a", "_m", "_by_distance", "_by_magnitude")


def _spans(cells: DataFrame, lo: str = "_lo", hi: str = "_hi") -> DataFrame:
    """What the places of a bracket's values are computed from, once per bracket. Values
    count in a power of two at which the bracket's width and its inverse are finite. A
    bracket without finite values has one place for them."""
    a, b = F.col(lo), F.col(hi)
    quarter = b * F.lit(0.25) - a * F.lit(0.25)
    k = F.when(quarter < F.lit(1e-200), F.lit(2.0 ** 600)).otherwise(F.lit(0.25))
    share = lambda width: F.coalesce(F.try_divide(F.lit(float(PLACES // 2)), width), F.lit(0.0))
    return (cells.withColumn("_k", k).withColumns({
        "_a": F.coalesce(a * F.col("_k"), F.lit(0.0)), "_m": F.coalesce(_magnitude(a), F.lit(0.0)),
        "_by_distance": share(b * F.col("_k") - a * F.col("_k")), "_by_magnitude": share(_magnitude(b) - _magnitude(a))}).drop(lo, hi))


def _join_cells(values: DataFrame, cells: DataFrame, n_cells: int, names: Sequence[str]) -> DataFrame:
    """The values that lie in one of ``cells``, with its columns. A cell is named by whole
    numbers that are never NULL: compared plainly, a pair of them is one long key, which
    costs a third of a null-safe join with every value."""
    return values.join(_safe_broadcast(cells, n_cells), list(names))


def percentile_table(df: DataFrame, cols: Sequence[str], qs: Sequence[float], by: Sequence[str] = (),
                     bracket_rows: int = BRACKET_ROWS, without: str | None = None, fill: bool = False) -> DataFrame:
    """Exact linear-interpolated percentiles: (by..., feature, q, value).

    One way at every size. Each wanted rank has a bracket, at first all values; while
    a bracket holds more than ``bracket_rows`` rows it is narrowed: its rows are counted
    per place (arithmetic on the value, some thousand places per bracket), and the exact
    counts say in which place the rank lies. Then the rows inside the brackets are
    counted per value and ranked inside their bracket. No value map and no bracket meets
    in one task beyond that bound; groups, NULL groups among them, stay in tables.
    Missing values (NULL, NaN) do not count; a feature without values has no row.

    ``without``: a column of few values (folds); there is a group per value, named by it,
    of all rows that do *not* have it. Rows are counted once per own value and only
    the counts are added up, so no row is multiplied. ``fill``: percentiles of the columns
    whose missing values are replaced by the group's median; only ranks are shifted."""
    table, held = _percentile_table(df, cols, qs, by, bracket_rows, without, fill)
    table = table.persist()
    table.count()                       # a row per group, feature and quantile
    for h in held:
        h.unpersist()
    return table


def _percentile_table(df: DataFrame, cols: Sequence[str], qs: Sequence[float], by: Sequence[str], bracket_rows: int,
                      without: str | None, fill: bool) -> tuple[DataFrame, list[DataFrame]]:
    """The table, not yet computed, and what is kept until it is."""
    cols, by, qs = list(cols), list(by), [float(q) for q in qs]
    own = [without] if without else []
    # every pass reads the wanted columns only, computed once
    names = [f"_c{i}" for i in range(len(cols))]
    src = df.select(*[col(b) for b in [*by, *own]], *[(num(c) + F.lit(0.0)).alias(n) for c, n in zip(cols, names)]).persist()
    held = [src]
    keys = [*by, "_f"]                  # whose rows are counted together
    groups = [*by, *own, "_f"]          # whose ranks are wanted
    parts = F.array(*[F.struct(F.lit(i).alias("f"), F.col(n).alias("v")) for i, n in enumerate(names)])
    every = (src.select(*[col(b) for b in [*by, *own]], F.explode(parts).alias("_s"))
             .select(*[col(b) for b in [*by, *own]], F.col("_s.f").alias("_f"), F.col("_s.v").alias("_v")))
    long = every.where(F.col("_v").isNotNull())
    ids = materialize(src.select(col(without).alias("_out")).distinct(), "checkpoint") if without else None

    def per_group(counts, cell, sums):
        """Counts per own value -> counts per group that leaves a value out."""
        if not without:
            return counts
        left = counts.crossJoin(F.broadcast(ids)).withColumn("_in", ~col(without).eqNullSafe(F.col("_out")))
        ends = [e for e in ("_lo", "_hi") if e in counts.columns]
        got = left.groupBy(*[col(c) for c in cell], F.col("_out").alias(without)).agg(
            *[F.sum(F.when(F.col("_in"), F.col(s)).otherwise(F.lit(0))).alias(s) for s in sums],
            *[(F.min if e == "_lo" else F.max)(e).alias(e) for e in ends])
        return got.where(F.col(sums[0]) > 0)

    finite = F.when(F.abs("_v") < F.lit(math.inf), F.col("_v"))
    first = every.groupBy(*[col(c) for c in [*keys, *own]]).agg(
        F.count("_v").alias("_n"), F.count(F.lit(1)).alias("_all"), F.min(finite).alias("_lo"), F.max(finite).alias("_hi"))
    sizes = per_group(first, keys, ["_n", "_all"]).where(F.col("_n") > 0)
    # the small tables are stored: each round's plan would hold those of all earlier ones
    sizes = materialize(sizes, "checkpoint")
    largest, n_spans = sizes.agg(F.coalesce(F.max("_n"), F.lit(0)), F.count(F.lit(1))).first()

    # a row per (feature, quantile) and end of its interval: the wanted rank
    n, q = F.col("_n"), F.col("_q")
    h = ((F.col("_all") if fill else n) - 1) * q
    middle = (n - 1) * F.lit(0.5)

    def rank(r):
        """Rank among the filled values -> rank among the values, none in the middle
        (the filled-in median), whose own two ranks are asked for as well."""
        if not fill:
            return r
        half = F.floor(middle)
        return F.when(r <= half, r).when(F.col("_all") - 1 - r <= half, r - (F.col("_all") - n))

    wanted = [rank(F.floor(h)), rank(F.ceil(h))] + ([F.floor(middle), F.ceil(middle)] if fill else [])
    ends = F.array(*[F.struct(F.lit(s).alias("s"), r.cast("long").alias("r")) for s, r in enumerate(wanted)])
    g = [col(c) for c in groups]
    tags = ["_n", "_all", "_q", "_s"]
    open_ = (sizes.select(*g, "_n", "_all", F.explode(F.array(*[F.lit(x) for x in qs])).alias("_q"))
             .select(*g, "_n", "_all", "_q", F.explode(ends).alias("_e"))
             .select(*g, "_n", "_all", "_q", F.col("_e.s").alias("_s"), F.col("_e.r").alias("_r"), F.lit(0).cast("long").alias("_below"))
             .where(F.col("_r").isNotNull()))
    done, inside, path = [], long, []
    # all groups' values of a feature are placed alike
    spans = _spans(sizes.groupBy("_f").agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi")))
    while largest > bracket_rows and len(path) < MAX_ROUNDS:
        place, cell = f"_p{len(path)}", [*keys, *path]
        inside = _with_place(_join_cells(inside, spans, n_spans, ["_f", *path]), place)
        counts = inside.groupBy(*[col(c) for c in [*cell, place, *own]]).agg(
            F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        w = Window.partitionBy(*g, *path).orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
        runs = per_group(counts, [*cell, place], ["_c"]).withColumn("_to", F.sum("_c").over(w))  # at most PLACES + 3 rows per bracket
        r = F.col("_r") - F.col("_below")
        state = (join_null_safe(open_, runs, [*groups, *path]).where((r >= F.col("_to") - F.col("_c")) & (r < F.col("_to")))
                 .select(*g, *tags, "_r", *path, place, (F.col("_below") + F.col("_to") - F.col("_c")).alias("_below"),
                         F.col("_c").alias("_inner"), "_lo", "_hi"))
        state = materialize(state, "checkpoint")
        done.append(state.where(F.col("_lo") == F.col("_hi")).select(*g, *tags, F.col("_lo").alias("_value")))
        state = state.where(F.col("_lo") < F.col("_hi"))
        largest, n_spans = state.agg(F.coalesce(F.max("_inner"), F.lit(0)), F.count(F.lit(1))).first()
        path.append(place)
        spans = _spans(state.groupBy("_f", *path).agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi")))
        open_ = state.drop("_inner", "_lo", "_hi")
    cell = [*keys, *path]
    if path:
        inside = _join_cells(inside, open_.select("_f", *path).distinct(), n_spans, ["_f", *path])
        if by:      # what is left lies in some group's bracket
            inside = join_null_safe(inside, _safe_broadcast(open_.select(*[col(c) for c in cell]).distinct(), n_spans), cell)
    counts = inside.groupBy(*[col(c) for c in [*cell, *own]], "_v").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*g, *path).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    runs = per_group(counts, [*cell, "_v"], ["_c"]).withColumn("_to", F.sum("_c").over(w))      # at most bracket_rows rows per bracket
    r = F.col("_r") - F.col("_below")
    hit = join_null_safe(runs, open_, [*groups, *path]).where((r >= F.col("_to") - F.col("_c")) & (r < F.col("_to")))
    found = hit.select(*g, *tags, F.col("_v").alias("_value"))
    for d in done:
        found = found.unionByName(d)
    at = lambda side: F.max(F.when(F.col("_s") == side, F.col("_value")))
    ends = found.groupBy(*g, *tags[:3]).agg(at(0).alias("_x"), at(1).alias("_y"), at(2).alias("_u"), at(3).alias("_v"))
    mid = F.col("_u") + (middle - F.floor(middle)) * (F.col("_v") - F.col("_u"))
    x, y = (F.coalesce(F.col(e), mid) for e in ("_x", "_y"))
    features = F.array(*[F.lit(c) for c in cols])
    out = ends.select(*[col(c) for c in [*by, *own]], features[F.col("_f")].alias("feature"), F.col("_q").alias("q"),
                      (x + (h - F.floor(h)) * (y - x)).alias("value"))
    return out, held


#: most fitted values that may become a driver-side parameter set
MAX_PARAMETERS = 1_000_000


def percentiles(df: DataFrame, cols: Sequence[str], qs: Sequence[float], by: Sequence[str] = (),
                bracket_rows: int = BRACKET_ROWS, without: str | None = None, fill: bool = False) -> dict:
    """:func:`percentile_table` as a parameter set ``{group_tuple: {col: [v_q for q in
    qs]}}`` for use in literal expressions. For groups whose number is not small by
    their meaning, use the table."""
    cols, by, qs = list(cols), list(by), [float(q) for q in qs]
    table, held = _percentile_table(df, cols, qs, by, bracket_rows, without, fill)
    try:
        rows = table.limit(MAX_PARAMETERS + 1).collect()
    finally:
        for h in held:
            h.unpersist()
    by += [without] if without else []
    if len(rows) > MAX_PARAMETERS:
        raise ValueError("too many groups for a parameter set; use percentile_table")
    out: dict = {} if by else {(): {}}
    for r in rows:
        out.setdefault(tuple(r[:len(by)]), {}).setdefault(r["feature"], {})[r["q"]] = float(r["value"])
    return {g: {c: [per.get(c, {}).get(q) for q in qs] for c in cols} for g, per in out.items()}


def percentile_column(df: DataFrame, column: str | Column, qs: Sequence[float], bracket_rows: int = BRACKET_ROWS) -> list[float | None]:
    """Percentiles of one (possibly derived) column over the whole frame."""
    name = column if isinstance(column, str) else "_pc"
    src = df if isinstance(column, str) else df.select(column.alias(name))
    return percentiles(src, [name], qs, (), bracket_rows)[()][name]


# ------------------------------------------------------------ hash ordering

def md5_hash(key: Column | str, seed: int = 42) -> Column:
    """Deterministic pseudo-random order key shared with the SQL oracle:
    ``md5(seed || '|' || key)``."""
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}|"), k.cast("string")))


def hash_bucket(h: Column, buckets: int) -> Column:
    """Integer bucket monotone in the hex hash ``h`` (first 32 bits)."""
    if buckets <= 1:
        return F.lit(0)
    top = F.conv(F.substring(h, 1, 8), 16, 10).cast("long")
    return F.floor(top * F.lit(buckets) / F.lit(4294967296)).cast("int")
