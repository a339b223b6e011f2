"""Files for points by name: substring candidates, and the ranking of them.

A point may stand anywhere in a file name. Where a name holds the first GRAM characters of some points, its parts of
these points' lengths are cut out from there, and a part meets the point that it equals. So points never meet all names,
none that fits is lost, and the work grows with the names and the different lengths of points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.sources.scratch import settled

GRAM = 3
#: Prefixes of generated files, in the order in which a name's own is looked for.
NAME_PREFIXES = ("_chatts_", "_qwen_", "global_chatts_", "chatts_", "qwen_", "timer_")
#: What a candidate's score adds and takes away.
STARTS, PART, INSIDE, HINT, HIDDEN, MODEL = 100, 60, 30, 10, 3, 5


#: Beginnings of points up to which they are broadcast.
FEW = 100_000


def substring_candidates(points: DataFrame, names: DataFrame) -> DataFrame:
    """Distinct (point, file_name) with the point inside the name; null and empty points have none."""
    names, points = names.select("file_name").distinct(), points.select("point").where("point <> ''").distinct()
    heads = settled(points.groupBy(F.substring("point", 1, GRAM).alias("head")).agg(F.collect_set(F.length("point")).alias("sizes")), "heads")
    heads = F.broadcast(heads) if heads.count() <= FEW else heads.hint("merge")
    # a head of fewer than GRAM characters is a whole point
    at = names.where("file_name <> ''").select("file_name", F.explode(F.sequence(F.lit(1), F.length("file_name"))).alias("at"))
    at = at.select("*", F.explode(F.array_distinct(F.array(*[F.substring("file_name", F.col("at"), F.lit(k)) for k in range(1, GRAM + 1)]))).alias("head"))
    parts = at.join(heads, "head").select("file_name", "at", F.explode("sizes").alias("size"))
    parts = parts.select(F.substring("file_name", F.col("at"), F.col("size")).alias("point"), "file_name").distinct()
    return parts.join(points.hint("merge"), "point", "left_semi")


def candidate_score(name: Column, point: Column, hint: Column) -> Column:
    low = F.lower(name)
    points = lambda test, n: F.when(test, F.lit(n)).otherwise(F.lit(0))
    good = points(F.startswith(name, point), STARTS) + points(F.contains(name, F.concat(F.lit("_"), point)), PART) + points(F.contains(name, point), INSIDE) + points(F.coalesce(F.contains(name, hint), F.lit(False)), HINT)
    bad = points(F.startswith(low, F.lit("_")), HIDDEN) + points(F.contains(low, F.lit("qwen")), MODEL) + points(F.contains(low, F.lit("chatts")), MODEL)
    return good - bad - F.length(name) / 200.0


def _files(inventory: DataFrame, extensions: tuple[str, ...]) -> DataFrame:
    """(file_name, modified): each name once, with its latest time."""
    time = F.max("modified") if "modified" in inventory.columns else F.lit(None).cast("timestamp")
    files = inventory.groupBy("file_name").agg(time.alias("modified"))
    kept = F.lit(not extensions)
    for e in extensions:
        kept |= F.endswith(F.lower("file_name"), F.lit(e))
    return files.where(kept)


def best_file(points: DataFrame, inventory: DataFrame, *keys: str, extensions: tuple[str, ...] = ()) -> DataFrame:
    """For each (keys, point) the file that ranks first: (keys, point, file_name, score).

    Files with the point in their name, of the given extensions, count; where some of them also have the point's `hint`
    (a column of points, optional), only those do. The highest score wins, then the latest `modified` (a column of the
    inventory, optional), then the first name.
    """
    hint = F.col("hint") if "hint" in points.columns else F.lit(None).cast("string")
    files = _files(inventory, extensions)
    found = points.withColumn("hint", hint).join(substring_candidates(points, files).hint("merge"), "point").join(files.hint("merge"), "file_name")
    score = candidate_score(F.col("file_name"), F.col("point"), F.col("hint"))
    hinted = F.coalesce(F.contains("file_name", F.col("hint")), F.lit(False)).cast("int")
    order = F.struct(-hinted, -F.round(score, 6), -F.coalesce(F.unix_micros(F.col("modified").cast("timestamp")), F.lit(0)), "file_name")
    best = F.min_by(F.struct("file_name", F.round(score, 6).alias("score")), order).alias("b")
    by = list(dict.fromkeys((*keys, "point")))
    return found.groupBy(*by).agg(best).select(*by, "b.file_name", "b.score")


def own_prefix(name: Column) -> Column:
    """The prefix of a generated file that a name begins with, null without one."""
    return F.coalesce(*[F.when(F.startswith(name, F.lit(p)), p) for p in NAME_PREFIXES])


def repaired_names(records: DataFrame, inventory: DataFrame, extensions: tuple[str, ...] = (".csv",)) -> DataFrame:
    """records (record, name, point) with `file_name` and `outcome`: unchanged where a file bears the name; changed to the
    best of the files with the point in their names: one with the prefix that the name itself has, then the latest, then
    the shortest, then the first; missing where there is none."""
    files = _files(inventory, extensions)
    exact = records.join(inventory.select(F.col("file_name").alias("name")).distinct(), "name", "left_semi").select("record", F.col("name").alias("file_name"), F.lit("unchanged").alias("outcome"))
    rest = records.join(exact.select("record"), "record", "left_anti")
    found = rest.join(substring_candidates(rest, files).hint("merge"), "point").join(files.hint("merge"), "file_name")
    same = F.coalesce(F.contains("file_name", own_prefix(F.col("name"))), F.lit(False)).cast("int")
    order = F.struct(-same, -F.coalesce(F.unix_micros(F.col("modified").cast("timestamp")), F.lit(0)), F.length("file_name"), "file_name")
    near = found.groupBy("record").agg(F.min_by("file_name", order).alias("file_name")).select("record", "file_name", F.lit("changed").alias("outcome"))
    missing = rest.join(near.select("record"), "record", "left_anti").select("record", F.lit(None).cast("string").alias("file_name"), F.lit("missing").alias("outcome"))
    return exact.union(near).union(missing)
