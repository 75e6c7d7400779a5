"""Correlation screens, correlation matrices, regression and smoothing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lociframe.functions.ordering import average_rank, bh_adjust, ranked_counts
from lociframe.functions.special import student_t_quantile, student_t_two_sided
from lociframe.operators.blocks import column_moments
from lociframe.operators.matrix import variable_features
from lociframe.session import cut_lineage


def pearson_from_sums(n: Column, sx: Column, sy: Column, sxy: Column, sxx: Column, syy: Column) -> Column:
    """r from co-moments, clipped to [-1, 1]; 0 for fewer than three pairs or no variation."""
    dx, dy = n * sxx - sx * sx, n * syy - sy * sy
    r = (n * sxy - sx * sy) / F.sqrt(dx * dy)
    return F.when((n < 3) | (dx <= 0) | (dy <= 0), F.lit(0.0)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p of r over n pairs; 1 for n < 3 and 0 for a perfect r."""
    df = (n - 2).cast("double")
    t = r * F.sqrt(df / F.greatest(F.lit(1e-300), 1 - r * r))
    p = student_t_two_sided(F.when(F.abs(r) < 1, t).otherwise(0.0), F.greatest(df, F.lit(1.0)))
    return F.when(n < 3, F.lit(1.0)).when(F.abs(r) >= 1, F.lit(0.0)).otherwise(p)


def comoments(lm: DataFrame, target: DataFrame) -> DataFrame:
    """Sums per feature of its pairs with the target vector (sample, y)."""
    x, y = F.col("value"), F.col("y")
    return (
        lm.where("value is not null").join(target.where("y is not null"), "sample").groupBy("feature").agg(
            F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * y).alias("sxy"),
            F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"),
        )
    )


def correlate_with(
    lm: DataFrame, target: DataFrame, method: str = "pearson", min_pairs: int = 10, min_sd: float = 0.01,
    min_variance: float | None = 0.01,
) -> DataFrame:
    """r, p, adjusted p of every feature with one vector (sample, y), rank correlation on request.

    Features of little variance, few shared samples or little spread on the shared samples are left out.
    """
    src = variable_features(lm, min_variance) if min_variance is not None else lm
    pairs = src.where("value is not null").join(target.where("y is not null"), "sample").select(
        "feature", "sample", "value", "y")
    kept = pairs
    if method == "spearman":
        spread = pairs.groupBy("feature").agg(F.stddev_pop("value").alias("sd")).where(F.col("sd") >= min_sd)
        pairs = pairs.join(spread.select("feature"), "feature", "left_semi")
        kept = average_rank(pairs, ["feature"], "value", "__rx")
        kept = average_rank(kept, ["feature"], "y", "__ry").select(
            "feature", "sample", F.col("__rx").alias("value"), F.col("__ry").alias("y"))
    stats = kept.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"), F.corr("value", "y").alias("r"), F.stddev_pop("value").alias("sd")
    ).where((F.col("n") >= min_pairs) & (F.col("sd") >= min_sd) & F.col("r").isNotNull() & ~F.isnan("r"))
    stats = stats.select("feature", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("r"))).alias("r"), "n")
    return bh_adjust(stats.withColumn("pvalue", correlation_p(F.col("r"), F.col("n"))), "pvalue", "fdr")


def correlation_matrix(lm: DataFrame, method: str = "pearson") -> DataFrame:
    """r of every pair of samples (a < b) over their shared features."""
    src = lm
    if method == "spearman":
        src = average_rank(lm.where("value is not null"), ["sample"], "value", "__r").select(
            "feature", "sample", F.col("__r").alias("value"))
    m = column_moments(src)
    c = [F.col(k) for k in ("n", "sx", "sy", "sxy", "sxx", "syy")]
    return m.select("a", "b", "n", pearson_from_sums(*c).alias("r"))


def pairwise_distance(lm: DataFrame, metric: str = "euclidean") -> DataFrame:
    """Distance of every pair of samples (a < b): euclidean, cosine, or correlation, over shared features."""
    m = column_moments(lm)
    sxx, syy, sxy = F.col("sxx"), F.col("syy"), F.col("sxy")
    if metric == "euclidean":
        d = F.sqrt(F.greatest(F.lit(0.0), sxx + syy - 2 * sxy))
    elif metric == "cosine":
        d = 1 - sxy / F.sqrt(sxx * syy)
    else:
        d = 1 - pearson_from_sums(*[F.col(k) for k in ("n", "sx", "sy", "sxy", "sxx", "syy")])
    return m.select("a", "b", d.alias("distance"))


def impute_knn(lm: DataFrame, k: int = 5) -> DataFrame:
    """Fill nulls of a complete grid with the mean of the k most correlated features that have a value.

    Neighbours are chosen by 1 - r over shared samples; cells that no neighbour can fill stay null.
    """
    lm = cut_lineage(lm)
    needy = cut_lineage(lm.where("value is null").select("feature").distinct())
    m = column_moments(lm.where("value is not null"), row="sample", col="feature")
    c = [F.col(x) for x in ("n", "sx", "sy", "sxy", "sxx", "syy")]
    varies = (c[0] * c[4] - c[1] * c[1] > 1e-9) & (c[0] * c[5] - c[2] * c[2] > 1e-9) & (c[0] >= 2)
    r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (c[0] * c[3] - c[1] * c[2]) / F.sqrt(
        (c[0] * c[4] - c[1] * c[1]) * (c[0] * c[5] - c[2] * c[2]))))
    near = m.where(varies).select("a", "b", F.round(1 - r, 9).alias("d"))
    both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "d"))
    w = W.partitionBy("feature").orderBy("d", "b")
    neighbours = (
        both.join(needy, F.col("a") == F.col("feature"), "inner").select("feature", "b", "d")
        .withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("feature", F.col("b").alias("other"))
    )
    gaps = lm.where("value is null").select("feature", "sample")
    values = lm.where("value is not null").select(F.col("feature").alias("other"), "sample", "value")
    fill = (
        gaps.join(neighbours, "feature").join(values, ["other", "sample"]).groupBy("feature", "sample")
        .agg(F.avg("value").alias("fill"))
    )
    return lm.join(fill, ["feature", "sample"], "left").select(
        "feature", "sample", F.coalesce("value", "fill").alias("value"))


def top_both_signs(df: DataFrame, top: int, r: str = "r", key: str = "feature") -> DataFrame:
    """The strongest positive and negative rows, half each; a short side gives its room to the other."""
    half = top // 2
    pos = df.where(F.col(r) > 0).orderBy(F.desc(r), key).limit(top).withColumn("side", F.lit("pos"))
    neg = df.where(F.col(r) < 0).orderBy(r, key).limit(top).withColumn("side", F.lit("neg"))
    # At most 2·top rows from here on, so one small window is enough.
    rows = pos.unionByName(neg)
    place = F.row_number().over(W.partitionBy("side").orderBy(F.desc(F.abs(r)), key))
    counts = F.sum(F.when(F.col("side") == "pos", 1).otherwise(0)).over(W.partitionBy(F.lit(0)))
    total = F.count(F.lit(1)).over(W.partitionBy(F.lit(0)))
    rows = rows.withColumn("place", place).withColumn("np", counts).withColumn("nn", total - counts)
    n_pos = F.when(F.least("np", F.lit(half)) < half, F.least("np", F.lit(half))).when(
        F.col("nn") < half, F.least(F.col("np"), top - F.col("nn"))).otherwise(F.lit(half))
    n_neg = F.when(F.col("np") < half, F.least(F.col("nn"), top - F.col("np"))).otherwise(F.least(F.col("nn"), F.lit(half)))
    keep = F.when(F.col("side") == "pos", F.col("place") <= n_pos).otherwise(F.col("place") <= n_neg)
    return rows.where(keep).drop("place", "np", "nn", "side")


def similarity_edges(df: DataFrame, top: int, threshold: float = 0.3, r: str = "r", key: str = "feature") -> DataFrame:
    """Edges between the ``top`` features whose r differ by less than the threshold, weight 1 - difference.

    Features meet through the cell of their r and the next one, so far-apart values never meet.
    """
    best = df.orderBy(F.desc(F.abs(r)), key).limit(top).select(key, r)
    cell = F.floor(F.col(r) / threshold)
    a = best.select(F.col(key).alias("src"), F.col(r).alias("ra"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    b = best.select(F.col(key).alias("dst"), F.col(r).alias("rb"), cell.alias("cell"))
    gap = F.abs(F.col("ra") - F.col("rb"))
    return a.join(b, "cell").where((F.col("src") < F.col("dst")) & (gap < threshold)).select(
        "src", "dst", (1 - gap).alias("weight"))


def linear_fit(df: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """Least squares line with r, standard error of the slope, t and p."""
    ok = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    agg = ok.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
        F.corr(x, y).alias("r"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.avg(x).alias("mean_x"),
        F.min(x).alias("min_x"), F.max(x).alias("max_x"),
    )
    resid = F.greatest(F.lit(0.0), F.col("syy") - F.col("slope") * F.col("slope") * F.col("sxx"))
    df2 = F.col("n") - 2
    out = agg.withColumn("se", F.sqrt(resid / df2 / F.col("sxx"))).withColumn("t", F.try_divide(F.col("slope"), F.col("se")))
    return out.withColumn("s_yx", F.sqrt(resid / df2)).withColumn("pvalue", correlation_p(F.col("r"), F.col("n")))


def fit_line_grid(fit: DataFrame, points: int = 100, level: float = 0.95) -> DataFrame:
    """The fitted line with the confidence band of its mean on an even grid."""
    fit = fit.withColumn("t_crit", student_t_quantile(F.lit(0.5 + level / 2), F.col("n") - 2))
    i = F.explode(F.sequence(F.lit(0), F.lit(points - 1)))
    grid = fit.withColumn("i", i).withColumn(
        "x", F.col("min_x") + (F.col("max_x") - F.col("min_x")) * F.col("i") / (points - 1))
    half = F.col("t_crit") * F.col("s_yx") * F.sqrt(1 / F.col("n") + F.pow(F.col("x") - F.col("mean_x"), 2) / F.col("sxx"))
    fitted = F.col("intercept") + F.col("slope") * F.col("x")
    return grid.select("i", "x", fitted.alias("fit"), (fitted - half).alias("lower"), (fitted + half).alias("upper"))


def loess(df: DataFrame, x: str, y: str, frac: float = 0.3, points: int = 100) -> DataFrame:
    """Local lines with tricube weights over the nearest frac·n points at each grid point.

    Points are first reduced to distinct x with counts and sums. The window of a grid point is an
    interval of x, found by exact order statistics of the distances of the reduced points.
    """
    pts = cut_lineage(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).alias("px")).agg(
        F.count(F.lit(1)).alias("c"), F.sum(y).alias("sy")))
    span = pts.agg(F.struct(F.min("px").alias("lo"), F.max("px").alias("hi"), F.sum("c").alias("n"))).scalar()
    at = (
        pts.withColumn("s", span).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
        .withColumn("x", F.col("s.lo") + (F.col("s.hi") - F.col("s.lo")) * F.col("i") / (points - 1))
        .withColumn("d", F.abs(F.col("px") - F.col("x")))
        .withColumn("k", F.greatest(F.lit(3), F.floor(F.col("s.n") * frac)))
        .drop("s")
    )
    at = cut_lineage(at)
    ranked = ranked_counts(at, ["i"], "d", weight="c", sums={"k": F.max("k")})
    # The window reaches to the distance of the k-th nearest point, whose own weight is zero.
    reach = ranked.where(F.col("cum") >= F.col("k")).groupBy("i").agg(F.min("d").alias("h"))
    near = at.join(reach, "i").where(F.col("d") <= F.col("h"))
    u = F.when(F.col("h") > 0, F.col("d") / F.col("h")).otherwise(0.0)
    w, c, px, sy = F.pow(1 - F.pow(u, 3), 3), F.col("c"), F.col("px") - F.col("x"), F.col("sy")
    sums = near.groupBy("i", "x").agg(
        F.sum(w * c).alias("sw"), F.sum(w * c * px).alias("swx"), F.sum(w * sy).alias("swy"),
        F.sum(w * c * px * px).alias("swxx"), F.sum(w * px * sy).alias("swxy"),
    )
    # Centred on the grid point, so the fit there is the intercept of the local line.
    det = F.col("sw") * F.col("swxx") - F.col("swx") * F.col("swx")
    line = (F.col("swxx") * F.col("swy") - F.col("swx") * F.col("swxy")) / det
    mean = F.try_divide(F.col("swy"), F.col("sw"))
    return sums.select("i", "x", F.when(F.abs(det) > 1e-12, line).otherwise(mean).alias("fit"))
