"""Name, path, text and cast expressions; each takes and returns a Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Methods that have a folder of results.
METHODS = ("chatts", "qwen", "timer", "adtk_hbos", "ensemble")


def sanitized(name: Column) -> Column:
    """Characters that are unsafe in file names become underscores."""
    return F.regexp_replace(name, r'[\\/:*?"<>|\s]+', "_")


def without_date_suffix(name: Column) -> Column:
    """A trailing _YYYYMMDD or _YYYY-MM-DD is dropped."""
    return F.regexp_replace(name, r"_\d{4}-?\d{2}-?\d{2}$", "")


def short_point(name: Column) -> Column:
    """The last part of a dotted path, without its date suffix."""
    return F.element_at(F.split(without_date_suffix(name), r"\."), -1)


def parsed_result_name(name: Column) -> Column:
    """Struct of method, sampler, point and date of `{method}_{sampler}_{point}_{date}`; null fields elsewhere."""
    pattern = r"^([a-z]+)_([a-z0-9]+)_(.+)_(\d{8})$"
    part = lambda k: F.nullif(F.regexp_extract(name, pattern, k), F.lit(""))
    return F.struct(part(1).alias("method"), part(2).alias("sampler"), part(3).alias("point"), F.try_to_timestamp(part(4), F.lit("yyyyMMdd")).cast("date").alias("day"))


def path_part_after(path: Column, marker: str) -> Column:
    """The folder that follows `marker` in a path, null where it does not occur."""
    parts = F.split(path, "/")
    at = F.array_position(parts, marker)
    return F.when(at > 0, F.try_element_at(parts, (at + 1).cast("int")))


def method_from_path(path: Column, known: bool = True) -> Column:
    """The method whose folder follows the first `inference` in a path, lower-cased. With `known` it is empty for a method
    that is not in METHODS and for other paths; without, any folder counts and other paths give null."""
    found = F.lower(path_part_after(F.regexp_replace(path, "/+", "/"), "inference"))
    return F.when(found.isin(*METHODS), found).otherwise("") if known else found


def candidate_names(name: Column) -> Column:
    """Ordered, distinct names that a record's file may bear."""
    stem = F.regexp_replace(name, r"\.json$", "")
    bare = F.regexp_replace(stem, r"^annotations_", "")
    return F.array_distinct(F.array(bare, F.concat(bare, F.lit(".csv")), stem, F.concat(stem, F.lit(".csv"))))


def safe_double(text: Column, default: float = 0.0) -> Column:
    return F.coalesce(text.try_cast("double"), F.lit(default))


def safe_int(text: Column, default: int = 0) -> Column:
    return F.coalesce(text.try_cast("int"), F.lit(default))


def widened(start: Column, end: Column, by: int = 5) -> tuple[Column, Column]:
    """A single-row label grows by `by` on either side, not below 0."""
    one = start == end
    return F.when(one, F.greatest(F.lit(0), start - by)).otherwise(start), F.when(one, end + by).otherwise(end)


def record_point(name: Column) -> Column:
    """The point of an annotation file: its name without extension, the annotation prefix and a dataset's prefix."""
    stem = F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"\.[^.]*$", "")
    return F.regexp_replace(stem, r"^(.*annotations_数据集zhlh_100_|annotations_)", "")


def point_id(text: Column) -> Column:
    """The `name.suffix` part of a path with the most underscores, then the longest; file extensions do not count."""
    found = F.regexp_extract_all(text, F.lit(r"([A-Za-z][A-Za-z0-9_]*\.[A-Za-z0-9]+)"))
    ids = F.filter(found, lambda x: ~F.rlike(F.lower(x), F.lit(r"\.(csv|json|jpg|png)$")))
    ranked = F.transform(ids, lambda x: F.struct((-F.length(F.regexp_replace(x, "[^_]", ""))).alias("u"), (-F.length(x)).alias("n"), x.alias("x")))
    return F.try_element_at(F.array_sort(ranked), F.lit(1))["x"]


def suffix_hint(name: Column) -> Column:
    """Which decomposed part of a series a name is about."""
    return F.when(F.contains(name, F.lit("trend_resid")), "trend_resid").when(F.contains(name, F.lit("resid")), "resid").when(F.contains(name, F.lit("trend")), "trend")


def normalised_time(text: Column) -> Column:
    """A time with or without a zone or slashes as `yyyy-MM-dd HH:mm:ss`; null where it cannot be read."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(text), "/", "-"), r"(Z|[+-]\d{2}:?\d{2})$", "")
    return F.date_format(F.try_to_timestamp(plain), "yyyy-MM-dd HH:mm:ss")
