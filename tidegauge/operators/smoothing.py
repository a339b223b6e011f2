"""Local and piecewise polynomial fits of series, ends included."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidegauge.operators.core import haloed


def _even_sums(m: Column) -> tuple[Column, Column, Column]:
    """Sums of t**2, t**4 and t**6 over t = -m..m."""
    base = m * (m + 1) * (2 * m + 1)
    return base / 3, base * (3 * m * m + 3 * m - 1) / 15, base * (3 * m * m * m * m + 6 * m * m * m - 3 * m + 1) / 21


def _fitted_end(name: str, m: Column, t: Column, order: int) -> Column:
    """Value at offset t of the polynomial fitted to the frame whose moments are {name}0 to {name}3."""
    s0, (s2, s4, s6) = 2 * m + 1, _even_sums(m)
    t0, t1, t2, t3 = (F.col(f"{name}{k}") for k in range(4))
    level, bend = t0 / s0, F.lit(0.0)
    if order >= 2:  # with one row there is no bend
        det = F.nullif(s0 * s4 - s2 * s2, F.lit(0.0))
        level, bend = F.coalesce((t0 * s4 - t2 * s2) / det, level), F.coalesce((s0 * t2 - s2 * t0) / det, bend)
    slope = F.coalesce(t1 / F.nullif(s2, F.lit(0.0)), F.lit(0.0)) if order >= 1 else F.lit(0.0)
    twist = F.lit(0.0)
    if order >= 3:  # three rows leave no twist
        det = F.when(m > 1, s2 * s6 - s4 * s4)
        slope, twist = F.coalesce((t1 * s6 - t3 * s4) / det, slope), F.coalesce((s2 * t3 - s4 * t1) / det, twist)
    return level + slope * t + bend * t * t + twist * t * t * t


def smooth(series: DataFrame, width: int, order: int) -> DataFrame:
    """`smooth`: at each row the value of the least-squares polynomial of an order up to 3 over `width` rows around it; at
    the ends of a point that of its first or last such frame. Points with fewer rows use the largest odd number of them.

    Positions are consecutive, from any first one. A frame with a null gives null. Inside, moments come from running sums over blocks whose positions count from the
    block, so that they keep their digits at any position; the two end frames of a point are one aggregation.
    """
    if width % 2 == 0 or not 0 <= order <= 3:
        raise ValueError("width must be odd and order 0 to 3")
    half = width // 2
    sizes = series.groupBy("point").agg(F.count("*").alias("_n"), F.min("pos").alias("_0"), F.coalesce(F.avg("value"), F.lit(0.0)).alias("_c"))
    sizes = sizes.withColumn("_m", F.least(F.lit(width), F.col("_n") - 1 + F.col("_n") % 2).cast("long") - 1).withColumn("_m", F.floor(F.col("_m") / 2))
    d = series.join(sizes, "point").withColumn("_v", F.col("value") - F.col("_c")).withColumn("_p", F.col("pos") - F.col("_0"))

    size = 4 * width  # running sums of squared positions lose no digits in blocks of a few frames
    block = W.partitionBy("point", "_block").orderBy("pos")
    inner = haloed(d, half + 1, half, size).withColumn("_j", (F.col("pos") - F.col("_block") * size).cast("double"))
    parts = {"k": F.col("_v").isNotNull().cast("int"), "x0": F.coalesce("_v", F.lit(0.0)), "x1": F.coalesce(F.col("_v") * F.col("_j"), F.lit(0.0)), "x2": F.coalesce(F.col("_v") * F.col("_j") * F.col("_j"), F.lit(0.0))}
    inner = inner.withColumns({f"_u{k}": F.sum(c).over(block) for k, c in parts.items()})
    inner = inner.withColumns({f"_f{k}": F.lead(f"_u{k}", half).over(block) - F.coalesce(F.lag(f"_u{k}", half + 1).over(block), F.lit(0)) for k in parts}).where("_own")
    j2, j4 = sum(j * j for j in range(-half, half + 1)), sum(j**4 for j in range(-half, half + 1))
    around = F.col("_fx2") - 2 * F.col("_j") * F.col("_fx1") + F.col("_j") * F.col("_j") * F.col("_fx0")
    centre = F.col("_fx0") / width if order < 2 or half == 0 else (j4 * F.col("_fx0") - j2 * around) / float(width * j4 - j2 * j2)
    whole = (F.col("_p") > F.col("_m")) & (F.col("_p") < F.col("_n") - 1 - F.col("_m"))
    inner = inner.withColumn("_inside", F.when(whole & (F.col("_fk") == width), centre))

    first, last = F.col("_p") <= 2 * F.col("_m"), F.col("_p") >= F.col("_n") - 1 - 2 * F.col("_m")
    offsets = {"a": (first, F.col("_p") - F.col("_m")), "z": (last, F.col("_p") - (F.col("_n") - 1 - F.col("_m")))}
    moments = [F.sum(F.when(there, F.col("_v") * F.pow(t.cast("double"), F.lit(k)))).alias(f"_{e}{k}") for e, (there, t) in offsets.items() for k in range(4)]
    known = [F.count(F.when(there, F.col("_v"))).alias(f"_{e}n") for e, (there, _) in offsets.items()]
    ends = d.where(first | last).groupBy("point").agg(*moments, *known)
    m = F.col("_m").cast("double")
    fit = {e: F.when(F.col(f"_{e}n") == 2 * F.col("_m") + 1, _fitted_end(f"_{e}", m, t.cast("double"), order)) for e, (_, t) in offsets.items()}
    value = F.when(whole, F.col("_inside")).when(F.col("_p") <= F.col("_m"), fit["a"]).otherwise(fit["z"])
    return inner.join(ends, "point").select(*series.columns, (value + F.col("_c")).alias("smooth"))


def piecewise_residual(series: DataFrame, degree: int = 12, trim: float = 0.1, value: str = "value", worst: float = 1e12) -> DataFrame:
    """`fitted` and `residual`: one polynomial over the positions of a point, and parabolas of their own over its first and
    last `trim` share of rows. Nulls, NaN and infinite values count as 0.

    The polynomial is a Chebyshev series; its sums, and those of both parabolas, are one aggregation, and each point has
    one small system to solve. The degree is lowered while the system's condition is beyond `worst`.
    """
    v = F.col(value).cast("double")
    clean = F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(v)
    sizes = series.groupBy("point").agg(F.count("*").alias("_n")).withColumn("_t", F.greatest(F.lit(1), F.floor(F.col("_n") * trim)))
    d = series.join(sizes, "point").withColumn("_v", clean).withColumn("_x", 2 * F.col("pos") / F.greatest(F.col("_n") - 1, F.lit(1)) - 1)
    # the Chebyshev polynomials on -1..1
    d = d.withColumn("_b", F.transform(F.sequence(F.lit(0), F.lit(degree)), lambda k: F.cos(k * F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("_x")))))))
    sides = {"a": (F.col("pos") < F.col("_t"), F.col("pos") - (F.col("_t") - 1) / 2), "z": (F.col("pos") >= F.col("_n") - F.col("_t"), F.col("pos") - (F.col("_n") - 1 - (F.col("_t") - 1) / 2))}
    gram = [F.sum(F.col("_b")[i] * F.col("_b")[j]).alias(f"g{i}_{j}") for i in range(degree + 1) for j in range(i, degree + 1)]
    right = [F.sum(F.col("_b")[i] * F.col("_v")).alias(f"r{i}") for i in range(degree + 1)]
    ends = [F.sum(F.when(there, F.pow(t, F.lit(k)) * (F.col("_v") if what == "v" else F.lit(1.0)))).alias(f"{e}_{what}{k}") for e, (there, t) in sides.items() for what, ks in (("v", (0, 1, 2)), ("s", (0, 2, 4))) for k in ks]
    sums = d.groupBy("point", "_t").agg(*gram, *right, *ends)

    def solve(batches):
        for pdf in batches:
            coef, parabolas = [], {"a": [], "z": []}
            for row in pdf.to_dict("records"):
                g = np.array([[row[f"g{min(i, j)}_{max(i, j)}"] for j in range(degree + 1)] for i in range(degree + 1)])
                r = np.array([row[f"r{i}"] for i in range(degree + 1)])
                n = next((k for k in range(degree + 1, 1, -1) if np.linalg.cond(g[:k, :k]) <= worst), 1)
                coef.append([*np.linalg.solve(g[:n, :n], r[:n]).tolist(), *[0.0] * (degree + 1 - n)])
                for e in "az":
                    (v0, v1, v2), (s0, s2, s4) = ([row[f"{e}_{w}{k}"] for k in ks] for w, ks in (("v", (0, 1, 2)), ("s", (0, 2, 4))))
                    if row["_t"] < 3:  # one or two rows are met exactly
                        parabolas[e].append([v0 / s0, v1 / s2 if s2 else 0.0, 0.0])
                    else:
                        det = s0 * s4 - s2 * s2
                        parabolas[e].append([(v0 * s4 - v2 * s2) / det, v1 / s2, (s0 * v2 - s2 * v0) / det])
            yield pd.DataFrame({"point": pdf["point"], "_coef": coef, "_pa": parabolas["a"], "_pz": parabolas["z"]})

    fits = sums.mapInPandas(solve, f"point {series.schema['point'].dataType.simpleString()}, _coef array<double>, _pa array<double>, _pz array<double>")
    fitted = F.aggregate(F.zip_with("_b", "_coef", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    parabola = lambda e: F.col(f"_p{e}")[0] + F.col(f"_p{e}")[1] * sides[e][1] + F.col(f"_p{e}")[2] * sides[e][1] * sides[e][1]
    curve = F.when(sides["z"][0], parabola("z")).when(sides["a"][0], parabola("a")).otherwise(fitted)
    out = d.join(fits, "point").withColumn("fitted", curve)
    return out.select(*series.columns, "fitted", (F.col("_v") - F.col("fitted")).alias("residual"))
