"""Aggregation, distribution, correlation and similarity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import aggregate, filters, geometry, ranking, similarity, stats
from ...operators.cells import points_to_cells
from ..adapters import FIBRE_GRID, FIBRE_RADIUS, PTS_GRID, VOX_GRID, Tables
from ..oracle_sql import compose
from ..workflows import density_correlation, density_on_grid, density_pairs, fibre_sv, sv_compare
from .geometry_queries import OVERLAP
from .registry import query, rounded


@query("valid_metric", compose("vox", "select volume_id, i, j, k, round(v, 6) as value from (select *, case when i % 3 = 0 then 0 when i % 3 = 1 then cast('nan' as double) else value_a end as v from vox) where not isnan(v) and v <> 0"))
def _(t: Tables):
    """Finite, non-zero values of a map with a third zeros and a third NaN."""
    holed = F.when(F.col("i") % 3 == 0, F.lit(0.0)).when(F.col("i") % 3 == 1, F.lit(float("nan"))).otherwise(F.col("value"))
    return rounded(filters.valid_metric(t.vox_a().withColumn("value", holed)))


@query("nan_to_num", compose("vox", "select volume_id, i, j, k, round(case when i % 3 = 1 then 0 else value_a end, 6) as value from vox"))
def _(t: Tables):
    holed = F.when(F.col("i") % 3 == 1, F.lit(float("nan"))).otherwise(F.col("value"))
    return rounded(filters.nan_to_num(t.vox_a().withColumn("value", holed)))


@query("both_positive", compose("vox", "select volume_id, i, j, k, round(value_a - 40000, 6) as a, round(value_b - 36000, 6) as b from vox where value_a > 40000 and value_b > 36000"))
def _(t: Tables):
    shifted = t.vox().select("volume_id", "i", "j", "k", (F.col("value_a") - 40000).alias("a"), (F.col("value_b") - 36000).alias("b"))
    return rounded(filters.both_positive(shifted, "a", "b"))


@query("join_maps", compose("vox", "select volume_id, i, j, k, round(value_a, 6) as a, round(value_b, 6) as b from vox where value_b > 36000"))
def _(t: Tables):
    """Two voxel tables joined on their integer coordinates."""
    return rounded(similarity.align(t.vox_a(), t.vox_b().where("value > 36000")))


@query("density_vs_metrics", compose("pairs", """
    select metric, volume_id, i, j, k, round(value, 6) as value, round(density, 6) as density from pairs
    where density > 0 and not density between 0 and 120 and not (metric = 'b' and value between 30000 and 36000)"""))
def _(t: Tables):
    """Density next to every metric after the exclusion rules."""
    return rounded(density_pairs(t.pts(), PTS_GRID, VOX_GRID, t.metrics(), exclude_zero=True, x_range=(0.0, 120.0),
                                 y_ranges={"a": None, "b": (30000.0, 36000.0)}))


@query("exclude_ranges", compose("metrics", """
    select metric, volume_id, i, j, k from metrics
    where not (metric = 'a' and value between 30000 and 50000) and not i between 10 and 20"""))
def _(t: Tables):
    kept = filters.exclude_ranges(t.metrics(), (10.0, 20.0), {"a": (30000.0, 50000.0)}, x="i")
    return kept.select("metric", "volume_id", "i", "j", "k")


@query("exclude_zero_density", compose("pairs", "select volume_id, i, j, k from pairs where metric = 'a' and density > 0"))
def _(t: Tables):
    out = density_on_grid(t.pts(), PTS_GRID, VOX_GRID, t.vox_a())
    return filters.exclude_zero_density(out).select("volume_id", "i", "j", "k")


@query("region_props", compose("labels2 field2", """
    select volume_id, label, count(*) as area, round(avg(l.i), 6) as centroid_i, round(avg(l.j), 6) as centroid_j,
           cast(0 as double) as centroid_k, round(avg(value), 6) as mean_intensity,
           round(sqrt(4 * count(*) / pi()), 6) as equivalent_diameter, cast(round_even(avg(l.i), 0) as bigint) as round_i,
           cast(round_even(avg(l.j), 0) as bigint) as round_j, cast(0 as bigint) as round_k
    from labels2 l join field2 using (volume_id, i, j, k) group by 1, 2"""))
def _(t: Tables):
    return rounded(aggregate.region_props(t.labels2(), t.field2()))


@query("component_centroids", compose("labels2", """
    select volume_id, label, count(*) as voxel_count, round(avg(i), 6) as center_x, round(avg(j), 6) as center_y,
           cast(0 as double) as center_z, cast(round_even(avg(i), 0) as bigint) as rounded_x,
           least(cast(round_even(avg(j), 0) as bigint), 40) as rounded_y, cast(0 as bigint) as rounded_z
    from labels2 group by 1, 2"""))
def _(t: Tables):
    """Centroids per label, clipped to a grid of 48×41 cells."""
    return rounded(aggregate.component_centroids(t.labels2(), (48, 41, 1)))


@query("histogram", compose("vox", """
    select volume_id, bin, round(lo + bin * w, 4) as bin_left, round(lo + bin * w + w, 4) as bin_right,
           round(lo + bin * w + w / 2, 4) as bin_center, coalesce(n, 0) as n
    from (select volume_id, cast(r.range as bigint) as bin, lo, w from range(50) r,
            (select volume_id, min(value_a) as lo, (max(value_a) - min(value_a)) / cast(50 as double) as w from vox group by 1))
    left join (select volume_id, least(cast(floor((value_a - lo) / w) as bigint), 49) as bin, count(*) as n from vox join
            (select volume_id, min(value_a) as lo, (max(value_a) - min(value_a)) / cast(50 as double) as w from vox group by 1) using (volume_id)
            group by 1, 2) using (volume_id, bin)"""))
def _(t: Tables):
    return rounded(aggregate.histogram(t.vox_a(), ["volume_id"], "value", 50), 4)


@query("histogram_fixed", compose("vox", """
    select volume_id, least(cast(floor((value_a - 20000) / cast(500 as double)) as bigint), 79) as bin, count(*) as n
    from vox where value_a between 20000 and 60000 group by 1, 2"""))
def _(t: Tables):
    return aggregate.histogram_fixed(t.vox_a(), ["volume_id"], "value", 20000, 60000, 500)


@query("range_counters", compose("vox", """
    select volume_id, count(*) as n_total, count(*) filter (where value_a between 20000 and 60000) as n_inside,
           count(*) filter (where value_a > 60000) as n_above from vox group by 1"""))
def _(t: Tables):
    return aggregate.range_counters(t.vox_a(), ["volume_id"], "value", 20000, 60000)


@query("summary_stats", compose("vox", """
    select volume_id, count(*) as n, round(min(value_a), 4) as min, round(max(value_a), 4) as max, round(avg(value_a), 4) as mean,
           count(*) as n_nonzero, round(median(value_a), 4) as median, cast(1 as double) as nonzero_ratio from vox group by 1"""))
def _(t: Tables):
    return rounded(aggregate.summary_stats(t.vox_a(), ["volume_id"], "value"), 4)


@query("masked_distribution", compose("vox", """
    select volume_id, count(*) as n, round(avg(v), 5) as mean, round(stddev_pop(v), 5) as std, round(min(v), 5) as min,
           round(max(v), 5) as max, count(*) filter (where v <= 0) as n_folding, round(quantile_cont(v, 0.01), 5) as p01,
           round(median(v), 5) as median, round(quantile_cont(v, 0.99), 5) as p99
    from (select volume_id, value_b / 10000 - 2 as v from vox where value_a > 30000) group by 1"""))
def _(t: Tables):
    mask = filters.threshold(t.vox_a(), 30000.0)
    scaled = t.vox_b().withColumn("value", F.col("value") / 10000 - 2)
    return rounded(aggregate.masked_distribution(scaled, mask), 5)


@query("foreground_bbox", compose("mask2", """
    select volume_id, min(i) as min_i, max(i) as max_i, min(j) as min_j, max(j) as max_j, min(k) as min_k, max(k) as max_k,
           cast((max(i) - min(i) + 1) * 3 as double) as extent_i, cast((max(j) - min(j) + 1) * 2 as double) as extent_j,
           cast((max(k) - min(k) + 1) as double) as extent_k from mask2 group by 1"""))
def _(t: Tables):
    return rounded(aggregate.foreground_bbox(t.mask2(), (3.0, 2.0, 1.0)))


@query("foreground_centroid", compose("mask2", """
    select volume_id, count(*) as n, round(avg(i * 3 + 1), 6) as center_x, round(avg(j * 2 - 1), 6) as center_y,
           cast(0 as double) as center_z from mask2 group by 1"""))
def _(t: Tables):
    return rounded(aggregate.foreground_centroid(t.mask2(), (3.0, 2.0, 1.0), (1.0, -1.0, 0.0)))


MOMENTS_SQL = """select volume_id, count(*) as n, {means}, {covs} from {source} group by 1"""


def moments_sql(source: str, digits: int) -> str:
    means = ", ".join(f"round(avg({c}), {digits}) + 0.0 as mean_{c}" for c in "xyz")
    covs = ", ".join(f"round(covar_samp({a}, {b}), {digits}) + 0.0 as cov_{a}{b}" for n, a in enumerate("xyz") for b in "xyz"[n:])
    return MOMENTS_SQL.format(means=means, covs=covs, source=source)


@query("pca_moments", compose("cloud", moments_sql("cloud", 6)))
def _(t: Tables):
    return rounded(aggregate.pca_moments(t.cloud()))


@query("pca_foreground", compose("vox", moments_sql("fg", 6), {
    "lim": "select volume_id, quantile_cont(value_a, 0.3) as q from vox where value_a <> 0 group by 1",
    "fg": "select volume_id, i * cast(3 as double) as x, j * cast(9 as double) as y, k * cast(2 as double) as z from vox join lim using (volume_id) where value_a > q"}))
def _(t: Tables):
    """Moments of the foreground above the 30th percentile, in physical coordinates."""
    points = aggregate.pca_foreground(t.vox_a()).select(
        "volume_id", (F.col("i") * 3.0).alias("x"), (F.col("j") * 9.0).alias("y"), (F.col("k") * 2.0).alias("z"))
    return rounded(aggregate.pca_moments(points))


@query("pca_axis", compose("cloud", """
    select volume_id, n, round(mean_x, 5) + 0.0 as center_x, round(mean_y, 5) + 0.0 as center_y, round(mean_z, 5) + 0.0 as center_z,
           round(cov_xx + cov_yy + cov_zz, 5) as trace, cast(0 as double) as residual
    from m""", {"m": moments_sql("cloud", 12)}))
def _(t: Tables):
    """Long axis, checked by the trace and by how far it is from being an eigenvector of the moments."""
    moments = aggregate.pca_moments(t.cloud())
    axes = aggregate.pca_axis(moments).join(moments.drop("n", "mean_x", "mean_y", "mean_z"), "volume_id")
    c = lambda a, b: F.col(f"cov_{min(a, b)}{max(a, b)}")
    away = [c(a, "x") * F.col("axis_x") + c(a, "y") * F.col("axis_y") + c(a, "z") * F.col("axis_z")
            - F.col("eigenvalue_1") * F.col(f"axis_{a}") for a in "xyz"]
    trace = F.col("eigenvalue_1") + F.col("eigenvalue_2") + F.col("eigenvalue_3")
    return rounded(axes.select("volume_id", "n", "center_x", "center_y", "center_z", trace.alias("trace"),
                               F.greatest(*[F.abs(a) for a in away]).alias("residual")), 5)


@query("otsu", compose("image", """
    select volume_id, round(arg_max(c, (b, -bin)), 4) as threshold from (
      select *, n1 * n2 * (m1 / n1 - (mall - m1) / n2) * (m1 / n1 - (mall - m1) / n2) as b from (
        select *, nall - n1 as n2 from (
          select volume_id, bin, c, sum(n) over w as n1, sum(n * c) over w as m1, sum(n) over (partition by volume_id) as nall,
                 sum(n * c) over (partition by volume_id) as mall
          from bars window w as (partition by volume_id order by bin rows unbounded preceding)))
      where n1 > 0 and n2 > 0) group by 1""", {
    "lim": "select volume_id, min(value) as lo, (max(value) - min(value)) / cast(256 as double) as w from image group by 1",
    "bars": """select volume_id, least(cast(floor((value - lo) / w) as bigint), 255) as bin,
                 lo + least(cast(floor((value - lo) / w) as bigint), 255) * w + w / 2 as c, count(*) as n
               from image join lim using (volume_id) group by volume_id, bin, c"""}))
def _(t: Tables):
    return rounded(aggregate.otsu(t.image()), 4)


@query("density_terciles", compose("pairs", """
    select metric, round(median(value) filter (where g = 1), 4) as low_median, count(*) filter (where g = 1) as low_n,
           round(median(value) filter (where g = 2), 4) as medium_median, count(*) filter (where g = 2) as medium_n,
           round(median(value) filter (where g = 3), 4) as high_median, count(*) filter (where g = 3) as high_n
    from (select metric, value, case when density <= q1 then 1 when density <= q2 then 2 else 3 end as g
          from pairs join (select metric, quantile_cont(density, cast(1 as double) / 3) as q1, quantile_cont(density, cast(2 as double) / 3) as q2
                           from pairs group by 1) using (metric)) group by 1"""))
def _(t: Tables):
    pairs = density_pairs(t.pts(), PTS_GRID, VOX_GRID, t.metrics())
    return rounded(stats.density_terciles(pairs, ["metric"], "density", "value"), 4)


@query("box_stats", compose("vox", """
    select volume_id, round(q1, 4) as q1, round(q2, 4) as median, round(q3, 4) as q3,
           round(min(value_a) filter (where value_a >= q1 - 1.5 * (q3 - q1)), 4) as whisker_low,
           round(max(value_a) filter (where value_a <= q3 + 1.5 * (q3 - q1)), 4) as whisker_high, count(*) as n
    from vox join (select volume_id, quantile_cont(value_a, 0.25) as q1, median(value_a) as q2, quantile_cont(value_a, 0.75) as q3
                   from vox group by 1) using (volume_id) group by volume_id, q1, q2, q3"""))
def _(t: Tables):
    return rounded(stats.box_stats(t.vox_a(), ["volume_id"], "value"), 4)


@query("hexbin", compose("pts", """
    select volume_id, d1 < d2 as main_lattice, cast(case when d1 < d2 then i1 else i2 end as bigint) as hex_i,
           cast(case when d1 < d2 then j1 else j2 end as bigint) as hex_j, count(*) as n, round(log10(count(*)), 6) as log10_n
    from (select *, (ux - i1) * (ux - i1) + 3 * (uy - j1) * (uy - j1) as d1,
                 (ux - i2 - 0.5) * (ux - i2 - 0.5) + 3 * (uy - j2 - 0.5) * (uy - j2 - 0.5) as d2
          from (select *, round_even(ux, 0) as i1, round_even(uy, 0) as j1, floor(ux) as i2, floor(uy) as j2
                from (select volume_id, (x - (x0 - 1e-9 * (x1 - x0))) / ((x1 + 1e-9 * (x1 - x0) - (x0 - 1e-9 * (x1 - x0))) / cast(60 as double)) as ux,
                             (y - (y0 - 1e-9 * (y1 - y0))) / ((y1 + 1e-9 * (y1 - y0) - (y0 - 1e-9 * (y1 - y0))) / cast(34 as double)) as uy
                      from pts join (select volume_id, min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1 from pts group by 1) using (volume_id))))
    group by 1, 2, 3, 4"""))
def _(t: Tables):
    return rounded(aggregate.hexbin(t.pts(), "x", "y"))


# --- correlation -------------------------------------------------------------------------------

@query("pearson", compose("vox", "select volume_id, count(*) as n, round(corr(value_a, value_b), 6) as pearson_r from vox group by 1"))
def _(t: Tables):
    return rounded(stats.pearson(t.vox(), ["volume_id"], "value_a", "value_b"))


@query("average_ranks", compose("counts", """
    select distinct volume_id, n_points, rank() over (partition by volume_id order by n_points)
           + (count(*) over (partition by volume_id, n_points) - 1) / cast(2 as double) as rank from counts"""))
def _(t: Tables):
    """Average rank of every distinct cell count."""
    counts = points_to_cells(t.pts(), PTS_GRID, VOX_GRID).groupBy("volume_id", "i", "j", "k").agg(F.count("*").alias("n_points"))
    return rounded(ranking.average_ranks(counts, ["volume_id"], "n_points"))


RANKED = """
    select *, rank() over (partition by {key} order by {x}) + (count(*) over (partition by {key}, {x}) - 1) / cast(2 as double) as rx,
           rank() over (partition by {key} order by {y}) + (count(*) over (partition by {key}, {y}) - 1) / cast(2 as double) as ry from {source}"""


@query("spearman", compose("pairs", "select metric, count(*) as n, round(corr(rx, ry), 6) as spearman_r from r group by 1",
                           {"r": RANKED.format(key="metric", x="density", y="value", source="pairs")}))
def _(t: Tables):
    pairs = density_pairs(t.pts(), PTS_GRID, VOX_GRID, t.metrics())
    return rounded(stats.spearman(pairs, ["metric"], "density", "value"))


FIT = """round(regr_slope({y}, {x}), 6) as slope, round(regr_intercept({y}, {x}), 4) as intercept,
    round(sqrt((regr_syy({y}, {x}) - regr_sxy({y}, {x}) * regr_sxy({y}, {x}) / regr_sxx({y}, {x})) / (count(*) - 2)) / sqrt(regr_sxx({y}, {x})), 6) as slope_se"""


@query("linear_fit", compose("vox", "select volume_id, count(*) as n, " + FIT.format(x="value_a", y="value_b") + " from vox group by 1"))
def _(t: Tables):
    fit = stats.linear_fit(t.vox(), ["volume_id"], "value_a", "value_b")
    return fit.select("volume_id", "n", F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"),
                      F.round("slope_se", 6).alias("slope_se"))


@query("statistics_guard", compose("vox", """
    select volume_id, i, count(*) as n, count(*) >= 3 and max(j) > min(j) and max(value_a) > min(value_a) as defined from vox group by 1, 2"""))
def _(t: Tables):
    return stats.guarded(t.vox_a(), ["volume_id", "i"], "j", "value")


@query("density_correlation", compose("pairs", """
    select metric, n, pearson_r, spearman_r, slope, intercept, slope_se, round(m1, 4) as low_median, n1 as low_n,
           round(m2, 4) as medium_median, n2 as medium_n, round(m3, 4) as high_median, n3 as high_n
    from (select metric, count(*) as n, round(corr(density, value), 6) as pearson_r, round(corr(rx, ry), 6) as spearman_r, """
    + FIT.format(x="density", y="value") + """ from r group by 1)
    join (select metric, median(value) filter (where density <= q1) as m1, count(*) filter (where density <= q1) as n1,
             median(value) filter (where density > q1 and density <= q2) as m2, count(*) filter (where density > q1 and density <= q2) as n2,
             median(value) filter (where density > q2) as m3, count(*) filter (where density > q2) as n3
          from r join (select metric, quantile_cont(density, cast(1 as double) / 3) as q1, quantile_cont(density, cast(2 as double) / 3) as q2
                       from pairs group by 1) using (metric) group by 1) using (metric)""",
    {"r": RANKED.format(key="metric", x="density", y="value", source="pairs")}))
def _(t: Tables):
    """Point density against voxel metrics: the columns that SQL can express."""
    out = density_correlation(t.pts(), PTS_GRID, VOX_GRID, t.metrics())
    six, four = ["pearson_r", "spearman_r", "slope", "slope_se"], ["intercept", "low_median", "medium_median", "high_median"]
    return out.select("metric", "n", *[F.round(c, 6).alias(c) for c in six], *[F.round(c, 4).alias(c) for c in four],
                      "low_n", "medium_n", "high_n")


def tail_sql(r: str) -> str:
    """Two-sided p-value of a correlation of n pairs: Simpson's rule on ``c·cos^(v-1)`` from ``atan(t/√v)``, in 4,000 steps over 15 widths ``1/√v``."""
    return f"""(select 2 * exp(lgamma((n - 1) / 2.0) - lgamma((n - 2) / 2.0)) / sqrt(pi()) * sum(w * pow(greatest(cos(least(low + h * m, pi() / 2)), 0), n - 3)) * h / 3
        from (select asin(abs({r})) as low, least(pi() / 2 - asin(abs({r})), 15 / sqrt(n - 2.0)) / 4000 as h),
             (select range as m, case when range in (0, 4000) then 1 when range % 2 = 1 then 4 else 2 end as w from range(4001)) group by low, h)"""


# The 97.5 % quantile of t with v degrees of freedom, expanded around that of the normal distribution.
T_SQL = """(z + (pow(z, 3) + z) / (4 * v) + (5 * pow(z, 5) + 16 * pow(z, 3) + 3 * z) / (96 * v * v)
    + (3 * pow(z, 7) + 19 * pow(z, 5) + 17 * pow(z, 3) - 15 * z) / (384 * pow(v, 3)))"""


@query("correlation_summary", compose("pairs", f"""
    select metric, n, round(pearson_r, 6) as pearson_r, round(spearman_r, 6) as spearman_r, round(slope, 4) as slope, round(intercept, 3) as intercept, round(slope_se, 5) as slope_se,
           round(slope - {T_SQL} * slope_se, 4) as slope_ci_lower, round(slope + {T_SQL} * slope_se, 4) as slope_ci_upper,
           round({tail_sql('pearson_r')}, 6) as pearson_p, round({tail_sql('spearman_r')}, 6) as spearman_p,
           round(m1, 4) as low_median, n1 as low_n, round(m2, 4) as medium_median, n2 as medium_n, round(m3, 4) as high_median, n3 as high_n
    from (select metric, count(*) as n, corr(density, value) as pearson_r, corr(rx, ry) as spearman_r, regr_slope(value, density) as slope, regr_intercept(value, density) as intercept,
             sqrt((regr_syy(value, density) - regr_sxy(value, density) * regr_sxy(value, density) / regr_sxx(value, density)) / (count(*) - 2)) / sqrt(regr_sxx(value, density)) as slope_se,
             cast(1.959963984540054 as double) as z, cast(count(*) - 2 as double) as v from r group by 1)
    join (select metric, median(value) filter (where density <= q1) as m1, count(*) filter (where density <= q1) as n1,
             median(value) filter (where density > q1 and density <= q2) as m2, count(*) filter (where density > q1 and density <= q2) as n2,
             median(value) filter (where density > q2) as m3, count(*) filter (where density > q2) as n3
          from r join (select metric, quantile_cont(density, cast(1 as double) / 3) as q1, quantile_cont(density, cast(2 as double) / 3) as q2
                       from pairs group by 1) using (metric) group by 1) using (metric)""",
    {"r": RANKED.format(key="metric", x="density", y="value", source="pairs")}, stored=("r",)))
def _(t: Tables):
    """The full summary with p-values and confidence limits."""
    out = density_correlation(t.pts(), PTS_GRID, VOX_GRID, t.metrics())
    digits = {"slope": 4, "intercept": 3, "slope_se": 5, "slope_ci_lower": 4, "slope_ci_upper": 4, "low_median": 4, "medium_median": 4, "high_median": 4}
    return rounded(out.withColumns({c: F.round(c, d) for c, d in digits.items()}))


@query("sv_compare", compose("vox", """
    select volume_id, count(*) as n, round(corr(value_a, value_b), 6) as pearson_r, round(corr(rx, ry), 6) as spearman_r from r group by 1""",
    {"r": RANKED.format(key="volume_id", x="value_a", y="value_b", source="(select * from vox where value_a > 0 and value_b > 0)")}))
def _(t: Tables):
    """Two maps compared cell by cell where both are positive."""
    return rounded(sv_compare(t.vox_a(), t.vox_b()))


# --- similarity --------------------------------------------------------------------------------

MI = {
    "lim": """select {keys}, quantile_cont(a, 0.01) as la, quantile_cont(a, 0.99) as ha, quantile_cont(b, 0.01) as lb,
              quantile_cont(b, 0.99) as hb from p group by {keys}""",
    "joint": """select {keys}, cast(least(floor((greatest(least(a, ha), la) - la) / (ha - la) * 64), 63) as bigint) as x,
                cast(least(floor((greatest(least(b, hb), lb) - lb) / (hb - lb) * 64), 63) as bigint) as y, count(*) as n
                from p join lim using ({keys}) group by {keys}, x, y""",
    "mi": """select {keys}, sum(cast(n as double) / t * ln(cast(n as double) * t / (nx * ny))) as mi from (
               select *, sum(n) over (partition by {keys}, x) as nx, sum(n) over (partition by {keys}, y) as ny,
                      sum(n) over (partition by {keys}) as t from joint) group by {keys}""",
    "ncc": "select {keys}, count(*) as n, corr(a, b) as ncc from p group by {keys}",
}


def similarity_sql(names: str, source: str, keys: str, body: str, extra: dict | None = None) -> str:
    return compose(names, body, {**(extra or {}), "p": source, **{n: s.format(keys=keys) for n, s in MI.items()}})


@query("mutual_information", similarity_sql("vox", "select volume_id, value_a as a, value_b as b from vox", "volume_id",
                                            "select volume_id, round(mi, 6) as mi from mi"))
def _(t: Tables):
    pairs = t.vox().select("volume_id", F.col("value_a").alias("a"), F.col("value_b").alias("b"))
    return rounded(similarity.mutual_information(pairs, ["volume_id"]))


@query("ncc", similarity_sql("vox", "select volume_id, value_a as a, value_b as b from vox", "volume_id",
                             "select volume_id, n, round(ncc, 6) as ncc from ncc"))
def _(t: Tables):
    pairs = t.vox().select("volume_id", F.col("value_a").alias("a"), F.col("value_b").alias("b"))
    return rounded(similarity.cross_correlation(pairs, ["volume_id"]))


@query("metrics_global_and_mask", similarity_sql("vox", """
    select volume_id, 'global' as scope, value_a as a, value_b as b from vox
    union all select volume_id, 'mask', value_a, value_b from vox where value_a > 40000""", "volume_id, scope",
    "select volume_id, scope, n, round(ncc, 6) as ncc, round(mi, 6) as mi from ncc join mi using (volume_id, scope)"))
def _(t: Tables):
    pairs = similarity.align(t.vox_a(), t.vox_b())
    return rounded(similarity.metrics_global_and_mask(pairs, filters.threshold(t.vox_a(), 40000.0)))


@query("orient_sign", compose("vox", """
    select volume_id, i, j, k, round(v * sign(median(v) filter (where value_a > 40000) over (partition by volume_id)), 4) as value
    from (select *, (30000 - value_b) * cast(0.7310585786300049 as double) as v from vox)"""))
def _(t: Tables):
    """Maps with a negative masked median are turned over."""
    mask = filters.threshold(t.vox_a(), 40000.0)
    return rounded(aggregate.orient_sign(t.vox_b().withColumn("value", (30000 - F.col("value")) * 0.7310585786300049), mask), 4)


@query("fibre_sv_histogram", compose("circles", """
    select volume_id, least(cast(floor(v / cast(0.0005 as double)) as bigint), 299) as bin, count(*) as n
    from (select volume_id, case when area > 1e-10 and 2500 - area > 1e-10 then arc / (2500 - area) else 0 end as v from cell_sums)
    where v between 0 and 0.15 group by 1, 2""", OVERLAP))
def _(t: Tables):
    """Fixed-width histogram of the surface-to-volume map of the circles."""
    return fibre_sv(t.circles(), FIBRE_GRID, FIBRE_RADIUS)["histogram"]
