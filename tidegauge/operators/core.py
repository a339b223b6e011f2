"""Positions, islands, interval algebra and as-of lookups over long series tables.

A series table has the columns point, pos, ts, value; an interval table has point, seg_id, start_pos, end_pos with
both ends included. Every function takes and returns DataFrames and keeps the work by point or by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def micros(column: Column | str) -> Column:
    """Microseconds of a time with or without a zone (then of the session's)."""
    return F.unix_micros((F.col(column) if isinstance(column, str) else column).cast("timestamp"))


def by_point(order: str = "pos", *keys: str) -> W:
    return W.partitionBy(*(keys or ("point",))).orderBy(order)


def rows(first: int, last: int, order: str = "pos") -> W:
    return by_point(order).rowsBetween(first, last)


def all_rows() -> W:
    return W.partitionBy("point")


def with_positions(series: DataFrame, *order: str) -> DataFrame:
    """pos from 0 in each point, by ts and then the given columns."""
    return series.withColumn("pos", F.row_number().over(W.partitionBy("point").orderBy("ts", *order)) - 1)


#: Rows that a task sorts, about, and rows of a point in one block; a longer frame makes larger blocks.
TASK_ROWS, BLOCK = 500_000, 65_536


def dealt(df: DataFrame, n_rows: int, *keys: str) -> DataFrame:
    """df by the hash of its keys over as many tasks as n_rows rows need. Few rows stay as Spark deals them."""
    n = -(-n_rows // TASK_ROWS)
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def _with_bases(df: DataFrame, bases: DataFrame, part: str) -> DataFrame:
    """df joined with one row for each (point, part); null is a key like any other."""
    b = bases.withColumnsRenamed({"point": "_point", part: "_part"})
    return df.join(b, F.col("point").eqNullSafe(F.col("_point")) & F.col(part).eqNullSafe(F.col("_part"))).drop("_point", "_part")


def with_positions_by_bucket(series: DataFrame, *order: str, bucket: str = "day") -> DataFrame:
    """The same numbering for giant points: rows are numbered inside a time bucket of their point and moved up by the
    rows in the buckets before, so no task sorts more than a bucket of a point."""
    cut = series.withColumn("_b", F.date_trunc(bucket, "ts"))
    sizes = cut.groupBy("point", "_b").agg(F.count("*").alias("_n"))
    before = W.partitionBy("point").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select("point", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    local = F.row_number().over(W.partitionBy("point", "_b").orderBy("ts", *order)) - 1
    out = _with_bases(dealt(cut, series.count(), "point", "_b").withColumn("_local", local), sizes, "_b")
    return out.withColumn("pos", (F.col("_local") + F.col("_base")).cast("long")).drop("_b", "_local", "_base")


def running(df: DataFrame, n_rows: int, column: str, name: str, part: str, *order: str) -> DataFrame:
    """df with the sum of a column over the rows of the point up to each row, by `part` (null first), then the given order
    inside it. Parts are summed alone and moved up by those before."""
    local = F.sum(column).over(W.partitionBy("point", part).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    sums = df.groupBy("point", part).agg(F.sum(column).alias("_sum"))
    before = W.partitionBy("point").orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    bases = sums.select("point", part, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    return _with_bases(dealt(df, n_rows, "point", part).withColumn("_local", local), bases, part).withColumn(name, F.col("_local") + F.col("_base")).drop("_local", "_base")


def islands(series: DataFrame, column: str, name: str = "grp") -> DataFrame:
    """Number of the run of equal values (null equals null) that a row is in, from 1. Blocks of positions count their own
    runs and are moved up by those of the blocks before, less one where a run goes on."""
    w = W.partitionBy("point", "_block").orderBy("pos")
    first = F.row_number().over(w) == 1
    changed = first | ~F.col(column).eqNullSafe(F.lag(column).over(w))
    d = dealt(series.withColumn("_block", F.floor(F.col("pos") / BLOCK)), series.count(), "point", "_block").withColumn("_c", changed.cast("int"))
    ends = d.groupBy("point", "_block").agg(F.sum("_c").alias("_n"), F.min_by(F.struct(column), "pos").alias("_first"), F.max_by(F.struct(column), "pos").alias("_last"))
    of_point = W.partitionBy("point").orderBy("_block")
    before = F.lag("_last").over(of_point)
    on = F.when(before.isNotNull() & F.col("_first")[column].eqNullSafe(before[column]), 1).otherwise(0)
    ends = ends.withColumn("_on", on).withColumn("_base", F.sum(F.col("_n") - F.col("_on")).over(of_point) - F.col("_n"))
    out = _with_bases(d, ends.select("point", "_block", "_base"), "_block")
    own = F.sum("_c").over(w)
    return out.withColumn(name, (own + F.col("_base")).cast("long")).select(*series.columns, name)


def split_runs(hits: DataFrame, min_size: int = 1, gap: int = 1) -> DataFrame:
    """Runs of positions that follow each other by exactly `gap`, of at least min_size rows."""
    w = by_point()
    step = F.col("pos") - F.lag("pos").over(w)
    new = F.coalesce((step != gap).cast("int"), F.lit(1))
    marked = hits.withColumn("_n", new).withColumn("run", F.sum("_n").over(w))
    runs = marked.groupBy("point", "run").agg(F.min("pos").alias("start_pos"), F.max("pos").alias("end_pos"), F.count("*").alias("n_rows"))
    return numbered_segments(runs.where(F.col("n_rows") >= min_size).drop("run"))


def numbered_segments(segments: DataFrame) -> DataFrame:
    """seg_id from 1 by start in each point."""
    return segments.withColumn("seg_id", F.row_number().over(W.partitionBy("point").orderBy("start_pos", "end_pos")).cast("long"))


def bridged(hits: DataFrame, gap: int | Column) -> DataFrame:
    """Hits, and the positions between two hits that are at most `gap` (of the later hit) apart, as segments."""
    w = by_point()
    new = F.coalesce((F.col("pos") - F.lag("pos").over(w) > gap).cast("int"), F.lit(1))
    runs = hits.withColumn("_n", new).withColumn("run", F.sum("_n").over(w)).groupBy("point", "run")
    return numbered_segments(runs.agg(F.min("pos").alias("start_pos"), F.max("pos").alias("end_pos")).drop("run"))


def merged_segments(segments: DataFrame, gap: int, strict: bool = False) -> DataFrame:
    """Segments whose start minus the end before is at most (or, strict, less than) `gap` become one."""
    w = W.partitionBy("point").orderBy("start_pos", "end_pos")
    reach = F.max("end_pos").over(w.rowsBetween(W.unboundedPreceding, -1))
    apart = F.col("start_pos") - reach
    new = F.coalesce(((apart >= gap) if strict else (apart > gap)).cast("int"), F.lit(1))
    runs = segments.withColumn("_n", new).withColumn("run", F.sum("_n").over(w)).groupBy("point", "run")
    return numbered_segments(runs.agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"), F.count("*").alias("n_merged")).drop("run"))


def mask_intervals(series: DataFrame, mask: str, end_mode: str = "last_true") -> DataFrame:
    """Intervals of true mask rows with positions and times. end_mode `first_false` ends at the row after the run
    where there is one."""
    w = by_point()
    marked = islands(series, mask).withColumn("_next_pos", F.lead("pos").over(w)).withColumn("_next_ts", F.lead("ts").over(w))
    hit = marked.where(F.col(mask) == 1)
    end_pos, end_ts = F.max("pos"), F.max("ts")
    if end_mode == "first_false":
        end_pos, end_ts = (F.max_by(F.coalesce(f"_next_{c}", c), F.col("pos")) for c in ("pos", "ts"))
    out = hit.groupBy("point", "grp").agg(F.min("pos").alias("start_pos"), end_pos.alias("end_pos"), F.min("ts").alias("start_ts"), end_ts.alias("end_ts"), F.count("*").alias("n_rows"))
    return numbered_segments(out.drop("grp"))


def expanded(segments: DataFrame, *keep: str) -> DataFrame:
    """One row for each position of each segment."""
    return segments.select("point", *keep, F.explode(F.sequence("start_pos", "end_pos")).alias("pos"))


def mask_from_segments(series: DataFrame, segments: DataFrame, name: str = "mask") -> DataFrame:
    """1 on the rows inside any segment. Segments never meet all rows of a point: ends are running counts by block."""
    ends = segments.select("point", F.col("start_pos").alias("pos"), F.lit(1).alias("_d")).union(segments.select("point", F.col("end_pos") + 1, F.lit(-1)))
    ends = ends.groupBy("point", "pos").agg(F.sum("_d").alias("_d"))
    both = series.withColumns({"_d": F.lit(0).cast("long"), "_kind": F.lit(1)}).unionByName(ends.withColumn("_kind", F.lit(0)), allowMissingColumns=True)
    both = both.withColumn("_block", F.floor(F.col("pos") / BLOCK))
    return _masked(running(both, series.count(), "_d", "_depth", "_block", "pos", "_kind"), series, name)


def _masked(counted: DataFrame, series: DataFrame, name: str) -> DataFrame:
    """The rows of the series among `counted`, with 1 where a segment is open."""
    others = [c for c in series.columns if c not in ("point", "pos", name)]
    return counted.where("_kind = 1").select("point", "pos", *others, (F.col("_depth") > 0).cast("int").alias(name))


def mask_in_time(series: DataFrame, ranges: DataFrame, name: str = "mask") -> DataFrame:
    """1 on the rows with a time inside any (point, start_ts, end_ts), both ends included; running counts by day."""
    ends = ranges.select("point", F.col("start_ts").alias("ts"), F.lit(1).alias("_d"), F.lit(0).alias("_kind")).union(ranges.select("point", "end_ts", F.lit(-1), F.lit(2)))
    both = series.withColumns({"_d": F.lit(0), "_kind": F.lit(1)}).unionByName(ends, allowMissingColumns=True).withColumn("_day", F.date_trunc("day", "ts"))
    return _masked(running(both, series.count(), "_d", "_depth", "_day", "ts", "_kind"), series, name)


def complement(series: DataFrame, hits: DataFrame) -> DataFrame:
    """Rows of the series that are no hits."""
    return series.join(hits.select("point", "pos"), ["point", "pos"], "left_anti")


def nearest(left: DataFrame, right: DataFrame, at: str = "ts", value: str = "pos", name: str = "near") -> DataFrame:
    """For each (point, at) of left the value of the nearest row of right, the earlier one of two as near."""
    sides = left.select("point", at, F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(None).cast("timestamp").alias("_t"), F.lit(1).alias("_q")).distinct()
    sides = sides.union(right.select("point", at, F.col(value), F.col(at), F.lit(0)))
    w = W.partitionBy("point").orderBy(at, "_q")
    back = w.rowsBetween(W.unboundedPreceding, 0)
    # backwards in time, as a frame that grows costs nothing and one that shrinks is worked out anew for each row
    ahead = W.partitionBy("point").orderBy(F.col(at).desc(), "_q").rowsBetween(W.unboundedPreceding, 0)
    pair = F.when(F.col("_t").isNotNull(), F.struct(F.col("_t").alias("t"), F.col("_v").alias("v")))
    found = sides.withColumn("_b", F.last(pair, True).over(back)).withColumn("_f", F.last(pair, True).over(ahead)).where("_q = 1")
    gap = lambda c: F.abs(micros(at) - micros(F.col(c)["t"]))
    pick = F.when(F.col("_f").isNull() | (gap("_b") <= gap("_f")), F.col("_b")["v"]).otherwise(F.col("_f")["v"])
    return left.join(found.select("point", at, pick.alias(name)), ["point", at])


def prefix_sums(series: DataFrame, value: str = "value", powers: int = 2) -> DataFrame:
    """Running sums s1, s2, ... of powers of the value less its point mean (column `centre`)."""
    centre = F.avg(value).over(all_rows())
    out = series.withColumn("centre", centre).withColumn("_d", F.col(value) - F.col("centre"))
    for k in range(1, powers + 1):
        out = out.withColumn(f"s{k}", F.sum(F.pow("_d", F.lit(k))).over(by_point()))
    return out.drop("_d")


def haloed(series: DataFrame, back: int, ahead: int, size: int | None = None) -> DataFrame:
    """Rows dealt to blocks of consecutive positions, with `back` rows before each block and `ahead` after it: columns
    _block, and _own for the rows that are no copies. Frames within these bounds need no other block of the point."""
    size = size or max(BLOCK, back + ahead + 1)
    at = lambda shift: F.floor((F.col("pos") + shift) / size)
    spread = series.withColumn("_block", F.explode(F.sequence(F.greatest(F.lit(0), at(-ahead)), at(back))))
    return spread.withColumn("_own", F.col("_block") == at(0))


def framed(series: DataFrame, frames: dict[str, tuple[int, int]], value: str = "value", powers: int = 1) -> DataFrame:
    """series with, for each frame [first, last] around a row, cut at the ends of the point: rows `{name}_n`, known values
    `{name}_k`, and sums `{name}_s1`, ... of powers of the known values less their mean over the point (`centre`).

    Sums are differences of running sums inside a block, so a frame's length costs nothing and no task sorts a point."""
    back, ahead = max(1 - min(f for f, _ in frames.values()), 0), max(max(f for _, f in frames.values()), 0)
    centres = series.groupBy("point").agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("centre"))
    size = max(BLOCK, back + ahead + 1)
    spread = haloed(series.join(centres, "point"), back, ahead, size)
    d = dealt(spread, series.count() * (size + back + ahead) // size, "point", "_block").withColumn("_d", F.col(value) - F.col("centre"))
    block = W.partitionBy("point", "_block")
    order = block.orderBy("pos")
    parts = {"n": F.lit(1), "k": F.col("_d").isNotNull().cast("int")} | {f"s{p}": F.coalesce(F.pow("_d", F.lit(p)), F.lit(0.0)) for p in range(1, powers + 1)}
    d = d.withColumns({f"_upto_{k}": F.sum(c).over(order) for k, c in parts.items()} | {f"_all_{k}": F.sum(c).over(block) for k, c in parts.items()})

    def at(part: str, shift: int) -> Column:
        upto = F.col(f"_upto_{part}")
        if shift == 0:
            return upto
        return F.coalesce(F.lead(upto, shift).over(order), F.col(f"_all_{part}")) if shift > 0 else F.coalesce(F.lag(upto, -shift).over(order), F.lit(0))

    d = d.withColumns({f"{name}_{part}": at(part, last) - at(part, first - 1) for name, (first, last) in frames.items() for part in parts})
    return d.where("_own").select(*series.columns, "centre", *[f"{name}_{part}" for name in frames for part in parts])


def neighbour_known(df: DataFrame, *columns: str) -> DataFrame:
    """Each null of the columns becomes the next known value of its point, or the last before where none follows. Blocks
    are filled inside; what they need of others comes from one row a block."""
    d = df.withColumn("_block", F.floor(F.col("pos") / BLOCK))
    own = W.partitionBy("point", "_block").orderBy("pos")
    edge = lambda f, c: f(c, F.when(F.col(c).isNotNull(), F.col("pos")))
    sums = d.groupBy("point", "_block").agg(*[x for c in columns for x in (edge(F.min_by, c).alias(f"_first_{c}"), edge(F.max_by, c).alias(f"_last_{c}"))])
    # one row a block; backwards as a frame that grows
    later = W.partitionBy("point").orderBy(F.desc("_block")).rowsBetween(W.unboundedPreceding, -1)
    before = W.partitionBy("point").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    near = sums.select("point", "_block", *[x for c in columns for x in (F.last(f"_first_{c}", True).over(later).alias(f"_next_{c}"), F.last(f"_last_{c}", True).over(before).alias(f"_prev_{c}"))])
    back = W.partitionBy("point", "_block").orderBy(F.desc("pos")).rowsBetween(W.unboundedPreceding, 0)
    ahead = own.rowsBetween(W.unboundedPreceding, 0)
    fill = {c: F.coalesce(F.last(c, True).over(back), F.col(f"_next_{c}"), F.last(c, True).over(ahead), F.col(f"_prev_{c}")) for c in columns}
    return dealt(d, df.count(), "point", "_block").join(near, ["point", "_block"]).withColumns(fill).select(*df.columns)


def next_known(value: Column, order: str = "pos") -> Column:
    """The value of this row or of the next that has one, else the last one before."""
    back = W.partitionBy("point").orderBy(F.col(order).desc()).rowsBetween(W.unboundedPreceding, 0)
    return F.coalesce(F.last(value, True).over(back), F.last(value, True).over(by_point(order).rowsBetween(W.unboundedPreceding, 0)))


def first_by(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")
