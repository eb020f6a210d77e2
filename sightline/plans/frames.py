"""Frames as pixel rows: long-run statistics, grids, motion, segments, masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import tone
from ..operators.components import components
from ..sources import views as V
from .registry import query

_P = f"WITH {V.PIXELS}"
_CELL = ["camera_id", "p"]


@query(f"{_P} SELECT camera_id, p, CAST(trunc(median(luma)) AS INTEGER) AS background FROM pixels GROUP BY camera_id, p")
def pixel_temporal_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median of a pixel over time, truncated."""
    return V.pixels(spark, sf_dir).groupBy(*_CELL).agg(F.median("luma").cast("int").alias("background"))


_STATS = f"{_P}, s AS (SELECT camera_id, p, px, py, median(luma) AS med, stddev_pop(luma) AS sd, avg(luma) AS mean, count(*) AS n FROM pixels GROUP BY camera_id, p, px, py)"


def cell_stats(px: DataFrame) -> DataFrame:
    return px.groupBy("camera_id", "p", "px", "py").agg(F.median("luma").alias("med"), F.stddev_pop("luma").alias("sd"), F.avg("luma").alias("mean"), F.count("*").alias("n"))


@query(f"{_STATS} SELECT camera_id, p, med AS median_luma, round(any_value(sd), 5) AS appearance_sd, round(avg(CASE WHEN abs(luma - med) <= greatest(sd, 1e-6) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 5) AS stability, any_value(n) AS n_frames FROM pixels JOIN s USING (camera_id, p) GROUP BY camera_id, p, med")
def pixel_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median, spread, and the share of frames within one spread of the median."""
    px = V.pixels(spark, sf_dir)
    near = (F.abs(F.col("luma") - F.col("med")) <= F.greatest("sd", F.lit(1e-6))).cast("double")
    both = px.select(*_CELL, "luma").join(cell_stats(px), _CELL)
    return both.groupBy(*_CELL, F.col("med").alias("median_luma")).agg(F.round(F.first("sd"), 5).alias("appearance_sd"), F.round(F.avg(near), 5).alias("stability"), F.first("n").alias("n_frames"))


@query(f"{_STATS}, dead AS (SELECT camera_id, px, py FROM s WHERE sd < 23.0 AND mean < 127) SELECT camera_id, p, NOT EXISTS (SELECT 1 FROM dead d WHERE d.camera_id = s.camera_id AND abs(d.px - s.px) <= 2 AND abs(d.py - s.py) <= 2) AS valid FROM s")
def validity_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells not within two of a dead one (bounds here suit the test frames)."""
    s = cell_stats(V.pixels(spark, sf_dir))
    return mark_valid(s, sd=23.0, mean=127.0).select(*_CELL, "valid")


def mark_valid(s: DataFrame, sd: float = 1.0, mean: float = 40.0, reach: int = 2) -> DataFrame:
    """Dead cells spread to their neighbourhood by offsets, an equi-join."""
    span = F.array(*[F.lit(d) for d in range(-reach, reach + 1)])
    dead = s.where((F.col("sd") < sd) & (F.col("mean") < mean)).select("camera_id", "px", F.explode(span).alias("dx"), "py").select("camera_id", (F.col("px") + F.col("dx")).alias("px"), "py", F.explode(span).alias("dy"))
    around = dead.select("camera_id", "px", (F.col("py") + F.col("dy")).alias("py")).distinct().withColumn("_dead", F.lit(True))
    return s.join(around, ["camera_id", "px", "py"], "left").withColumn("valid", F.col("_dead").isNull()).drop("_dead")


@query(f"""{_P}, d AS (SELECT camera_id, 'column' AS axis, px - 1 AS line, abs(luma - lag(luma) OVER (PARTITION BY frame_id, py ORDER BY px)) AS step FROM pixels
  UNION ALL SELECT camera_id, 'row', py - 1, abs(luma - lag(luma) OVER (PARTITION BY frame_id, px ORDER BY py)) FROM pixels), c AS (SELECT camera_id, axis, line, avg(step) AS m FROM d WHERE step IS NOT NULL GROUP BY ALL),
f AS (SELECT camera_id, axis, line % 8 AS phase, avg(m) AS m FROM c GROUP BY ALL), s AS (SELECT camera_id, axis, arg_max(phase, (m, -phase)) AS top, max(m) / median(m) AS excess, median(m) AS middle FROM f GROUP BY ALL)
SELECT camera_id, axis, CAST(phase AS INTEGER) AS phase, phase = top AS peak, round(excess, 5) AS excess, CASE WHEN excess >= 1.5 THEN round(least(1.0, greatest(0.05, middle / m)), 5) END AS weight FROM f JOIN s USING (camera_id, axis)""")
def grid_phase_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which phases of a codec's grid of eight have the steps, on both axes, and how
    much evidence each phase still gives; no weight where there is no grid."""
    return grid_prior(V.pixels(spark, sf_dir))


def grid_prior(px: DataFrame, period: int = 8, least: float = 1.5) -> DataFrame:
    """``(camera_id, axis, phase, peak, excess, weight)``. A line's step is that to
    the next line; lines of one phase are averaged; the peak is the first greatest
    phase, its excess that over the median phase."""

    def lines(axis: str, across: str, name: str) -> DataFrame:
        step = F.abs(F.col("luma") - F.lag("luma").over(Window.partitionBy("frame_id", across).orderBy(axis)))
        return px.select("camera_id", F.lit(name).alias("axis"), (F.col(axis) - 1).alias("line"), step.alias("step"))

    both = lines("px", "py", "column").unionByName(lines("py", "px", "row")).where("step IS NOT NULL")
    by_line = both.groupBy("camera_id", "axis", "line").agg(F.avg("step").alias("m"))
    f = by_line.groupBy("camera_id", "axis", (F.col("line") % period).cast("int").alias("phase")).agg(F.avg("m").alias("m"))
    s = f.groupBy("camera_id", "axis").agg(F.max_by("phase", F.struct(F.col("m"), -F.col("phase"))).alias("top"), F.median("m").alias("middle"), F.max("m").alias("most"))
    excess = F.col("most") / F.col("middle")
    weight = F.when(excess >= least, F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.05), F.col("middle") / F.col("m"))), 5))
    return f.join(s, ["camera_id", "axis"]).select("camera_id", "axis", "phase", (F.col("phase") == F.col("top")).alias("peak"), F.round(excess, 5).alias("excess"), weight.alias("weight"))


@query(f"{_P} SELECT frame_id, p, CAST(trunc(luma * (1 - 0.6::DOUBLE * (1 - CASE px % 4 WHEN 3 THEN 0.4::DOUBLE ELSE 1 END)) * (1 - 0.6::DOUBLE * (1 - CASE py % 4 WHEN 3 THEN 0.5::DOUBLE ELSE 1 END))) AS INTEGER) AS luma FROM pixels")
def grid_discount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Separable weights of grid lines taken off by a strength."""
    wx, wy = (F.when(F.col(c) % 4 == 3, w).otherwise(1.0) for c, w in (("px", 0.4), ("py", 0.5)))
    return V.pixels(spark, sf_dir).select("frame_id", "p", (F.col("luma") * (1 - 0.6 * (1 - wx)) * (1 - 0.6 * (1 - wy))).cast("int").alias("luma"))


def _pull(value: str, line: str, part: list[str], on: Column, weight: float, strength: float) -> Column:
    w = Window.partitionBy(*part).orderBy(line)
    a, b = F.lag(value).over(w), F.lead(value).over(w)
    k = (1 - weight) * strength
    pulled = F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.col(value) * (1 - k) + (a + b) / 2 * k)).cast("int")
    return F.when(on & a.isNotNull() & b.isNotNull() & F.lit(k > 0.01), pulled).otherwise(F.col(value))


_K = "0.36::DOUBLE"


@query(f"""{_P}, a AS (SELECT frame_id, p, px, py, CASE WHEN px % 4 = 3 AND px < 7 THEN CAST(trunc(luma * (1 - {_K}) + (lag(luma) OVER w + lead(luma) OVER w) / 2.0::DOUBLE * {_K}) AS INTEGER) ELSE luma END AS v FROM pixels WINDOW w AS (PARTITION BY frame_id, py ORDER BY px))
SELECT frame_id, p, CASE WHEN py % 4 = 3 AND py < 7 THEN CAST(trunc(v * (1 - {_K}) + (lag(v) OVER w + lead(v) OVER w) / 2.0::DOUBLE * {_K}) AS INTEGER) ELSE v END AS luma FROM a WINDOW w AS (PARTITION BY frame_id, px ORDER BY py)""")
def deblock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid columns drawn towards their neighbours' mean, then rows of the result;
    borders stay."""
    px = V.pixels(spark, sf_dir)
    cols = px.withColumn("luma", _pull("luma", "px", ["frame_id", "py"], F.col("px") % 4 == 3, 0.4, 0.6))
    return cols.withColumn("luma", _pull("luma", "py", ["frame_id", "px"], F.col("py") % 4 == 3, 0.4, 0.6)).select("frame_id", "p", "luma")


@query(f"""{_P}, l AS (SELECT frame_id, px, py, lag(luma) OVER x + lead(luma) OVER x + lag(luma) OVER y + lead(luma) OVER y - 4 * luma AS d FROM pixels WINDOW x AS (PARTITION BY frame_id, py ORDER BY px), y AS (PARTITION BY frame_id, px ORDER BY py))
SELECT frame_id, round(var_pop(d), 4) AS sharpness, floor(least(1.0, greatest(0.3, var_pop(d) / 36000.0::DOUBLE)) * 10000 + 0.5::DOUBLE) / 10000 AS scale FROM l GROUP BY frame_id""")
def laplacian_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sharpness: variance of the four-neighbour Laplacian inside the frame."""
    x, y = Window.partitionBy("frame_id", "py").orderBy("px"), Window.partitionBy("frame_id", "px").orderBy("py")
    d = F.lag("luma").over(x) + F.lead("luma").over(x) + F.lag("luma").over(y) + F.lead("luma").over(y) - 4 * F.col("luma")
    v = F.var_pop("d")
    return V.pixels(spark, sf_dir).withColumn("d", d).groupBy("frame_id").agg(F.round(v, 4).alias("sharpness"), (F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.3), v / 36000.0)) * 10000 + 0.5) / 10000.0).alias("scale"))


@query(f"""{_P}, d AS (SELECT frame_id, abs(luma - lag(luma) OVER (PARTITION BY camera_id, p ORDER BY frame_id)) AS d FROM pixels)
SELECT frame_id, round(avg(d), 5) AS motion, count(*) FILTER (d > 18) AS moving, round(max(d), 1)::INTEGER AS largest FROM d WHERE d IS NOT NULL GROUP BY frame_id""")
def frame_diff_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difference to the camera's frame before; the first frame has none."""
    d = F.abs(F.col("luma") - F.lag("luma").over(Window.partitionBy(*_CELL).orderBy("frame_id")))
    return V.pixels(spark, sf_dir).withColumn("d", d).where("d IS NOT NULL").groupBy("frame_id").agg(F.round(F.avg("d"), 5).alias("motion"), F.count_if(F.col("d") > 18).alias("moving"), F.max("d").alias("largest"))


@query(f"""{_P}, b AS (SELECT frame_id, p, luma, lag(luma, 1) OVER w AS a, lag(luma, 2) OVER w AS z FROM pixels WINDOW w AS (PARTITION BY camera_id, p ORDER BY frame_id))
SELECT frame_id, p, CAST(CASE WHEN a IS NULL THEN luma WHEN z IS NULL THEN round_even(0.5::DOUBLE * luma + 0.5::DOUBLE * a, 0) ELSE round_even(0.6::DOUBLE * luma + 0.2::DOUBLE * a + 0.2::DOUBLE * z, 0) END AS INTEGER) AS luma FROM b""")
def temporal_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted mean with the two frames before; one: halves; none: as it is."""
    w = Window.partitionBy(*_CELL).orderBy("frame_id")
    v, a, z = F.col("luma"), F.lag("luma", 1).over(w), F.lag("luma", 2).over(w)
    blended = F.when(a.isNull(), v.cast("double")).when(z.isNull(), F.bround(v * 0.5 + a * 0.5, 0)).otherwise(F.bround(v * 0.6 + a * 0.2 + z * 0.2, 0))
    return V.pixels(spark, sf_dir).select("frame_id", "p", blended.cast("int").alias("luma"))


@query(f"{_P}, m AS (SELECT frame_id, px // 4 AS bx, py // 4 AS by_, avg(luma) AS m FROM pixels GROUP BY ALL) SELECT frame_id, p, CAST(trunc(m) AS INTEGER) AS luma FROM pixels JOIN m USING (frame_id) WHERE px // 4 = bx AND py // 4 = by_")
def mosaic_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    block = Window.partitionBy("frame_id", F.floor(F.col("px") / 4), F.floor(F.col("py") / 4))
    return V.pixels(spark, sf_dir).select("frame_id", "p", F.avg("luma").over(block).cast("int").alias("luma"))


@query(f"{_P} SELECT frame_id, px // 2 AS bx, py // 2 AS by_, CAST(round_even(avg(luma), 0) AS INTEGER) AS luma FROM pixels GROUP BY ALL")
def area_downscale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.pixels(spark, sf_dir).groupBy("frame_id", F.floor(F.col("px") / 2).cast("int").alias("bx"), F.floor(F.col("py") / 2).cast("int").alias("by_")).agg(F.bround(F.avg("luma"), 0).cast("int").alias("luma"))


@query(f"{_P} SELECT frame_id, p, CAST(round_even(0.299::DOUBLE * luma + 0.587::DOUBLE * (255 - luma) + 0.114::DOUBLE * (luma // 2), 0) AS INTEGER) AS gray FROM pixels")
def gray_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Luma weights over three channels, here derived from one."""
    r, g, b = F.col("luma"), F.lit(255) - F.col("luma"), F.floor(F.col("luma") / 2)
    return V.pixels(spark, sf_dir).select("frame_id", "p", F.bround(r * 0.299 + g * 0.587 + b * 0.114, 0).cast("int").alias("gray"))


_BG = f"{_P}, b AS (SELECT camera_id, p, px, py, CAST(trunc(median(luma)) AS INTEGER) AS g FROM pixels GROUP BY ALL), r AS (SELECT camera_id, min(g) AS lo, max(g) AS hi FROM b GROUP BY camera_id)"


def _background(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.pixels(spark, sf_dir).groupBy("camera_id", "p", "px", "py").agg(F.median("luma").cast("int").alias("g"))


def bands(background: DataFrame, n: int = 6) -> DataFrame:
    """Luminance bands of the background; a range under 1 gives none."""
    r = background.groupBy("camera_id").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("hi - lo >= 1")
    return background.join(r, "camera_id").withColumn("band", F.least(F.lit(n - 1), ((F.col("g") - F.col("lo")) / (F.col("hi") - F.col("lo")) * n).cast("int")))


_BANDED = f"{_BG}, banded AS (SELECT b.*, least(5, CAST(trunc((g - lo) / (hi - lo)::DOUBLE * 6) AS INTEGER)) AS band FROM b JOIN r USING (camera_id) WHERE hi - lo >= 1)"


@query(f"{_BANDED} SELECT camera_id, p, band FROM banded")
def luma_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bands(_background(spark, sf_dir)).select("camera_id", "p", "band")


@query(f"""{_P} SELECT frame_id, p, least(255, CASE WHEN luma <= 200 THEN luma ELSE CAST(trunc(200 + 55 * ((luma - 200) / 55.0::DOUBLE)) AS INTEGER) END + CAST(trunc(12.0::DOUBLE * greatest(110 - luma, 0) / 110) AS INTEGER)) AS luma FROM pixels""")
def tone_lut_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.pixels(spark, sf_dir).select("frame_id", "p", tone.applied(F.col("luma"), tone.tone(lift=12.0)).alias("luma"))


@query(f"{_P}, d AS (SELECT frame_id, abs(luma - lag(luma) OVER (PARTITION BY frame_id, py ORDER BY px)) AS d FROM pixels) SELECT frame_id, round(quantile_cont(d, 0.99), 4) AS reference, round(quantile_cont(d, 0.5), 4) AS middle FROM d GROUP BY frame_id")
def edge_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """High percentile of the edge response, to which strokes are scaled."""
    d = F.abs(F.col("luma") - F.lag("luma").over(Window.partitionBy("frame_id", "py").orderBy("px")))
    return V.pixels(spark, sf_dir).withColumn("d", d).groupBy("frame_id").agg(F.round(F.percentile("d", 0.99), 4).alias("reference"), F.round(F.percentile("d", 0.5), 4).alias("middle"))


@query(f"{_P} SELECT frame_id, p, round(CASE WHEN d >= 0.3 THEN 1.0::DOUBLE ELSE 1 + tanh(2.5::DOUBLE * (d - 0.3::DOUBLE)) END, 5) AS ink FROM (SELECT frame_id, p, luma / 255.0::DOUBLE AS d FROM pixels)")
def xdog_ramp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Soft threshold of the extended difference of Gaussians."""
    d = F.col("luma") / 255.0
    return V.pixels(spark, sf_dir).select("frame_id", "p", F.round(F.when(d >= 0.3, 1.0).otherwise(1 + F.tanh((d - 0.3) * 2.5)), 5).alias("ink"))


@query(f"{_P}, f AS (SELECT frame_id, p, luma, avg(luma) OVER (PARTITION BY frame_id) AS m, avg(luma) OVER (PARTITION BY frame_id, px // 4, py // 4) AS field FROM pixels) SELECT frame_id, p, CAST(least(255, greatest(0, trunc(luma * pow(m / greatest(field, 1), 0.7::DOUBLE)))) AS INTEGER) AS luma FROM f")
def illumination_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gain (mean / field)^0.7, with block means as the slow field."""
    px = V.pixels(spark, sf_dir)
    frame = Window.partitionBy("frame_id")
    field = F.avg("luma").over(Window.partitionBy("frame_id", F.floor(F.col("px") / 4), F.floor(F.col("py") / 4)))
    gain = F.pow(F.avg("luma").over(frame) / F.greatest(field, F.lit(1.0)), F.lit(0.7))
    return px.select("frame_id", "p", F.least(F.lit(255), F.greatest(F.lit(0), (F.col("luma") * gain).cast("int"))).alias("luma"))


_FG = f"{_P}, bg AS (SELECT camera_id, p, median(luma) AS med FROM pixels GROUP BY ALL), fg AS (SELECT frame_id, camera_id, px, py, p, abs(luma - med) > 40 AS on_ FROM pixels JOIN bg USING (camera_id, p))"


def foreground(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels far from their background."""
    px = V.pixels(spark, sf_dir)
    bg = px.groupBy(*_CELL).agg(F.median("luma").alias("med"))
    return px.join(bg, _CELL).select("frame_id", "camera_id", "px", "py", "p", (F.abs(F.col("luma") - F.col("med")) > 40).alias("on_"))


@query(f"{_FG} SELECT camera_id, p, round(avg(CASE WHEN on_ THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 5) AS fg_fraction FROM fg GROUP BY camera_id, p")
def foreground_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return foreground(spark, sf_dir).groupBy(*_CELL).agg(F.round(F.avg(F.col("on_").cast("double")), 5).alias("fg_fraction"))


@query(f"""{_FG}, boxes AS (SELECT vec_id AS frame_id, vec_id % 6 AS bx, vec_id % 5 AS by_, vec_id % 4 AS bw FROM embeddings)
SELECT frame_id, round(coalesce(avg(CASE WHEN on_ THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 1.0), 5) AS fg_consistency FROM boxes LEFT JOIN fg USING (frame_id) WHERE on_ IS NULL OR (px >= bx AND px < bx + bw AND py >= by_ AND py < by_ + bw) GROUP BY frame_id
UNION ALL SELECT frame_id, 1.0 FROM boxes WHERE bw = 0""")
def box_foreground(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a box that is foreground; a box without area is neutral."""
    v = F.col("vec_id")
    boxes = V.table(spark, sf_dir, "embeddings").select(v.alias("frame_id"), (v % 6).alias("bx"), (v % 5).alias("by_"), (v % 4).alias("bw"))
    within = (F.col("px") >= F.col("bx")) & (F.col("px") < F.col("bx") + F.col("bw")) & (F.col("py") >= F.col("by_")) & (F.col("py") < F.col("by_") + F.col("bw"))
    share = foreground(spark, sf_dir).join(boxes, "frame_id").where(within).groupBy("frame_id").agg(F.avg(F.col("on_").cast("double")).alias("s"))
    return boxes.join(share, "frame_id", "left").select("frame_id", F.round(F.coalesce("s", F.lit(1.0)), 5).alias("fg_consistency"))


@query(f"""{_FG}, m AS (SELECT frame_id, camera_id, p, on_, (px + py) % 2 = 0 AS even FROM fg)
SELECT frame_id, count(*) FILTER (on_ OR even) AS either, count(*) FILTER (on_ AND even) AS both_, count(*) FILTER (NOT on_) AS neither, count(*) FILTER (on_ AND NOT even) AS minus FROM m GROUP BY frame_id""")
def mask_set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    on, even = F.col("on_"), (F.col("px") + F.col("py")) % 2 == 0
    return foreground(spark, sf_dir).groupBy("frame_id").agg(F.count_if(on | even).alias("either"), F.count_if(on & even).alias("both_"), F.count_if(~on).alias("neither"), F.count_if(on & ~even).alias("minus"))


@query(f"{_FG}, c AS (SELECT * FROM fg WHERE on_) SELECT DISTINCT f.frame_id, f.p FROM fg f JOIN c ON c.frame_id = f.frame_id AND abs(c.px - f.px) <= 1 AND abs(c.py - f.py) <= 1")
def mask_dilation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """3 x 3 dilation by offsets: no join, each set pixel names its neighbours."""
    near = F.array(*[F.lit(d) for d in (-1, 0, 1)])
    on = foreground(spark, sf_dir).where("on_")
    wide = on.withColumn("dx", F.explode(near)).withColumn("dy", F.explode(near)).select("frame_id", (F.col("px") + F.col("dx")).alias("px"), (F.col("py") + F.col("dy")).alias("py"))
    return wide.where("px BETWEEN 0 AND 7 AND py BETWEEN 0 AND 7").select("frame_id", (F.col("py") * 8 + F.col("px")).alias("p")).distinct()


_ADJ = f"""{_BANDED}, pairs AS (
  SELECT camera_id, band AS a, lead(band) OVER (PARTITION BY camera_id, py ORDER BY px) AS b FROM banded UNION ALL SELECT camera_id, band, lead(band) OVER (PARTITION BY camera_id, px ORDER BY py) FROM banded
), adj AS (SELECT DISTINCT camera_id, least(a, b) AS a, greatest(a, b) AS b FROM pairs WHERE b IS NOT NULL AND a <> b)"""


def _adjacent(banded: DataFrame) -> DataFrame:
    right = banded.select("camera_id", F.col("band").alias("a"), F.lead("band").over(Window.partitionBy("camera_id", "py").orderBy("px")).alias("b"))
    down = banded.select("camera_id", F.col("band").alias("a"), F.lead("band").over(Window.partitionBy("camera_id", "px").orderBy("py")).alias("b"))
    return right.unionAll(down).where("b IS NOT NULL AND a <> b").select("camera_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


@query(f"{_ADJ} SELECT * FROM adj")
def segment_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _adjacent(bands(_background(spark, sf_dir)))


@query(f"{_BANDED} SELECT camera_id, band, count(*) AS area, round(avg(g), 4) AS mean_luma, round(avg(py / 8.0::DOUBLE), 4) AS centroid_y, min(px) AS x0, max(px) AS x1 FROM banded GROUP BY camera_id, band HAVING avg(g) >= 25 AND count(*) >= 0.02 * 64")
def segment_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area, place and brightness of segments that are neither dark nor tiny."""
    s = bands(_background(spark, sf_dir)).groupBy("camera_id", "band").agg(F.count("*").alias("area"), F.avg("g").alias("m"), F.round(F.avg(F.col("py") / 8.0), 4).alias("centroid_y"), F.min("px").alias("x0"), F.max("px").alias("x1"))
    return s.where("m >= 25 AND area >= 0.02 * 64").select("camera_id", "band", "area", F.round("m", 4).alias("mean_luma"), "centroid_y", "x0", "x1")


_MERGE = f"""{_ADJ}, colour AS (SELECT camera_id, band, avg(g) AS m FROM banded GROUP BY ALL), near AS (
  SELECT a.camera_id, a.a, a.b FROM adj a JOIN colour x ON a.camera_id = x.camera_id AND a.a = x.band JOIN colour y ON a.camera_id = y.camera_id AND a.b = y.band WHERE abs(x.m - y.m) < 9)"""


@query(_MERGE.replace("WITH ", "WITH RECURSIVE ", 1) + """, both_ AS (SELECT camera_id, a, b FROM near UNION SELECT camera_id, b, a FROM near), reach AS (SELECT camera_id, band AS a, band AS b FROM colour UNION SELECT r.camera_id, r.a, e.b FROM reach r JOIN both_ e ON r.camera_id = e.camera_id AND r.b = e.a)
, roots AS (SELECT camera_id, a AS band, min(b) AS root FROM reach GROUP BY ALL) SELECT camera_id, band, CAST(dense_rank() OVER (PARTITION BY camera_id ORDER BY root) - 1 AS INTEGER) AS label FROM roots""")
def segment_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjacent segments of like brightness become one, numbered without gaps."""
    banded = bands(_background(spark, sf_dir))
    colour = banded.groupBy("camera_id", F.col("band").alias("label")).agg(F.avg("g").alias("m"))
    a, b = (colour.select("camera_id", F.col("label").alias(c), F.col("m").alias(f"m{c}")) for c in "ab")
    near = _adjacent(banded).join(a, ["camera_id", "a"]).join(b, ["camera_id", "b"]).where("abs(ma - mb) < 9").select("camera_id", "a", "b")
    roots = components(colour, near, ["camera_id"])
    return roots.select("camera_id", F.col("label").alias("band"), (F.dense_rank().over(Window.partitionBy("camera_id").orderBy("root")) - 1).alias("label"))


@query(_FG.replace("WITH ", "WITH RECURSIVE ", 1) + """, s AS (SELECT frame_id, p, px, py FROM fg WHERE on_), e AS (SELECT a.frame_id, a.p AS a, b.p AS b FROM s a JOIN s b ON a.frame_id = b.frame_id AND abs(a.px - b.px) <= 1 AND abs(a.py - b.py) <= 1)
, reach AS (SELECT frame_id, a, b FROM e UNION SELECT r.frame_id, r.a, e.b FROM reach r JOIN e ON r.frame_id = e.frame_id AND r.b = e.a), roots AS (SELECT frame_id, a AS p, min(b) AS root FROM reach GROUP BY ALL)
SELECT frame_id, root, count(*) AS area, min(px) AS x0, min(py) AS y0, max(px) AS x1, max(py) AS y1 FROM roots JOIN s USING (frame_id, p) GROUP BY frame_id, root""")
def blob_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight-neighbour components of the foreground with box and area; the edges
    come from four offsets, so each frame adds at most four for a pixel."""
    s = foreground(spark, sf_dir).where("on_").select("frame_id", "p", "px", "py")
    ways = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((1, 0), (0, 1), (1, 1), (-1, 1))])
    ends = s.select("frame_id", F.col("p").alias("a"), "px", "py", F.explode(ways).alias("d")).select("frame_id", "a", (F.col("px") + F.col("d.dx")).alias("px"), (F.col("py") + F.col("d.dy")).alias("py"))
    edges = ends.join(s.withColumnRenamed("p", "b"), ["frame_id", "px", "py"]).select("frame_id", "a", "b")
    roots = components(s.select("frame_id", F.col("p").alias("label")), edges, ["frame_id"])
    return s.withColumnRenamed("p", "label").join(roots, ["frame_id", "label"]).groupBy("frame_id", "root").agg(F.count("*").alias("area"), F.min("px").alias("x0"), F.min("py").alias("y0"), F.max("px").alias("x1"), F.max("py").alias("y1"))


@query(_BANDED + """, n AS (SELECT camera_id, band, count(*) AS n FROM banded WHERE px BETWEEN 2 AND 5 AND py BETWEEN 2 AND 5 GROUP BY ALL) SELECT camera_id, CAST(arg_max(band, (n, -band)) AS INTEGER) AS band, max(n) AS n FROM n GROUP BY camera_id""")
def dominant_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most frequent label in the middle; of equal ones the first."""
    n = bands(_background(spark, sf_dir)).where("px BETWEEN 2 AND 5 AND py BETWEEN 2 AND 5").groupBy("camera_id", "band").agg(F.count("*").alias("n"))
    return n.groupBy("camera_id").agg(F.max_by("band", F.struct(F.col("n"), -F.col("band"))).alias("band"), F.max("n").alias("n"))


_STAB = f"{_STATS}, t AS (SELECT camera_id, p, px, py, avg(CASE WHEN abs(luma - med) <= greatest(sd, 1e-6) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS stability FROM pixels JOIN s USING (camera_id, p, px, py) GROUP BY ALL)"


@query(f"{_STAB}, q AS (SELECT camera_id, quantile_cont(stability, 0.35) AS bound FROM t GROUP BY camera_id) SELECT camera_id, p, round(stability, 5) AS stability, py >= 8 * 0.55 AS low_band FROM t JOIN q USING (camera_id) WHERE stability > bound")
def stable_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells above the 35th percentile of stability; which lie in the lowest band."""
    px = V.pixels(spark, sf_dir)
    near = (F.abs(F.col("luma") - F.col("med")) <= F.greatest("sd", F.lit(1e-6))).cast("double")
    t = px.select(*_CELL, "luma").join(cell_stats(px), _CELL).groupBy("camera_id", "p", "py").agg(F.avg(near).alias("stability"))
    q = t.groupBy("camera_id").agg(F.percentile("stability", 0.35).alias("bound"))
    return t.join(q, "camera_id").where("stability > bound").select("camera_id", "p", F.round("stability", 5).alias("stability"), (F.col("py") >= 8 * 0.55).alias("low_band"))


@query(f"{_P} SELECT frame_id, p, CASE WHEN frame_id % 5 = 0 THEN 0 ELSE luma END AS luma FROM pixels")
def hidden_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Black takes the place of hidden frames, here every fifth; nothing of the
    picture goes into it."""
    return V.pixels(spark, sf_dir).select("frame_id", "p", F.when(F.col("frame_id") % 5 == 0, F.lit(0)).otherwise(F.col("luma")).alias("luma"))


@query("SELECT vec_id AS frame_id FROM embeddings WHERE vec_id % 3 = 0")
def stride_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "embeddings").where("vec_id % 3 = 0").select(F.col("vec_id").alias("frame_id"))


@query("""WITH n AS (SELECT vec_id % 2 AS camera_id, vec_id, row_number() OVER (PARTITION BY vec_id % 2 ORDER BY vec_id) - 1 AS r, count(*) OVER (PARTITION BY vec_id % 2) AS n FROM embeddings), i AS (SELECT DISTINCT camera_id, CAST(trunc(k * (n - 1) / 29.0::DOUBLE) AS BIGINT) AS r FROM (SELECT DISTINCT camera_id, n FROM n), range(30) t(k))
SELECT camera_id, vec_id AS frame_id FROM n JOIN i USING (camera_id, r)""")
def even_subsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 30 frames of a camera, evenly spread."""
    w = Window.partitionBy("camera_id")
    n = V.table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 2).alias("camera_id"), F.col("vec_id").alias("frame_id"), (F.row_number().over(Window.partitionBy(F.col("vec_id") % 2).orderBy("vec_id")) - 1).cast("long").alias("r")).withColumn("n", F.count("*").over(w))
    spots = n.select("camera_id", "n").distinct().select("camera_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(29)), lambda k: (k * (F.col("n") - 1) / 29.0).cast("long"))).alias("r")).distinct()
    return n.join(spots, ["camera_id", "r"]).select("camera_id", "frame_id")


_CAND = "c AS (SELECT p_partkey AS i, (p_size % 25) / 25.0::DOUBLE AS area, (p_partkey % 10) / 10.0::DOUBLE AS covered, (p_partkey % 7) / 7.0::DOUBLE AS cy FROM part)"


@query(f"WITH {_CAND} SELECT i, round(area * (1 - covered) * (0.5 + cy), 6) AS score FROM c ORDER BY area * (1 - covered) * (0.5 + cy) DESC, i LIMIT 4")
def floor_candidate_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Floor candidates: large, bare and low in the picture."""
    area, covered, cy = (F.col("p_size") % 25) / 25.0, (F.col("p_partkey") % 10) / 10.0, (F.col("p_partkey") % 7) / 7.0
    return V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("i"), (area * (1 - covered) * (cy + 0.5)).alias("s")).orderBy(F.desc("s"), "i").limit(4).select("i", F.round("s", 6).alias("score"))


@query(f"WITH {_CAND}, b AS (SELECT *, (i % 100) / 100.0::DOUBLE AS wx, (i % 97) / 96.0::DOUBLE AS wy FROM c) SELECT i, area FROM b WHERE area BETWEEN 0.006 AND 0.60 AND NOT (wx >= 0.92 AND wy >= 0.92) ORDER BY area DESC, i LIMIT 12")
def candidate_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, area = F.col("p_partkey"), (F.col("p_size") % 25) / 25.0
    c = V.table(spark, sf_dir, "part").select(i.alias("i"), area.alias("area"), ((i % 100) / 100.0).alias("wx"), ((i % 97) / 96.0).alias("wy"))
    return c.where("area BETWEEN 0.006 AND 0.60 AND NOT (wx >= 0.92 AND wy >= 0.92)").orderBy(F.desc("area"), "i").limit(12).select("i", "area")


_QUAD = "q AS (SELECT p_partkey AS i, unnest([0, 1, 2, 3]) AS k, p_partkey * 37 % 100 AS a, p_size AS s FROM part), v AS (SELECT i, k, (a * (k + 3) * 13) % 101 AS x, (s * (k + 1) * 29) % 103 AS y FROM q)"


@query(f"""WITH {_QUAD}, r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY y DESC, k) AS n FROM v), t AS (SELECT *, n <= 2 AS near, row_number() OVER (PARTITION BY i, n <= 2 ORDER BY x, k) AS side FROM r)
SELECT i, max(k) FILTER (near AND side = 1) AS nl, max(k) FILTER (near AND side = 2) AS nr, max(k) FILTER (NOT near AND side = 2) AS fr, max(k) FILTER (NOT near AND side = 1) AS fl FROM t GROUP BY i""")
def quad_corner_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners named near and far by y, left and right by x, within one row."""
    k = F.sequence(F.lit(0), F.lit(3))
    a, s = F.col("p_partkey") * 37 % 100, F.col("p_size")
    v = F.transform(k, lambda j: F.struct((-(s * (j + 1) * 29 % 103)).alias("ny"), j.alias("k"), (a * (j + 3) * 13 % 101).alias("x")))
    by_y = V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("i"), F.array_sort(v).alias("v"))

    def sides(start: int) -> Column:
        return F.array_sort(F.transform(F.slice("v", start, 2), lambda e: F.struct(e["x"].alias("x"), e["k"].alias("k"))))

    two = by_y.select("i", sides(1).alias("near"), sides(3).alias("far"))
    return two.select("i", *[F.get(c, F.lit(n))["k"].alias(name) for name, c, n in (("nl", "near", 0), ("nr", "near", 1), ("fr", "far", 1), ("fl", "far", 0))])


@query(f"""{_P}, e AS (SELECT camera_id, min(frame_id) + max(frame_id) AS ends FROM pixels GROUP BY ALL), h AS (SELECT camera_id, p, 2 * frame_id < ends AS early, avg(luma) AS m FROM pixels JOIN e USING (camera_id) GROUP BY ALL)
SELECT camera_id, round(avg(abs(a.m - b.m)), 4) AS score, avg(abs(a.m - b.m)) > 40 AS stale FROM h a JOIN h b USING (camera_id, p) WHERE a.early AND NOT b.early GROUP BY camera_id""")
def stale_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean difference of the backgrounds of the older and the newer half of a
    camera's frames, above 40 stale."""
    px = V.pixels(spark, sf_dir)
    ends = px.groupBy("camera_id").agg((F.min("frame_id") + F.max("frame_id")).alias("ends"))
    early = 2 * F.col("frame_id") < F.col("ends")
    m = px.join(ends, "camera_id").groupBy(*_CELL).agg(F.avg(F.when(early, F.col("luma"))).alias("a"), F.avg(F.when(~early, F.col("luma"))).alias("b"))
    d = F.avg(F.abs(F.col("a") - F.col("b")))
    return m.where("a IS NOT NULL AND b IS NOT NULL").groupBy("camera_id").agg(F.round(d, 4).alias("score"), (d > 40).alias("stale"))


@query(f"{_P}, g AS (SELECT camera_id, frame_id // 8 AS window_, p, avg(luma) AS m FROM pixels WHERE (frame_id // 2) % 4 < 4 GROUP BY ALL) SELECT camera_id, window_, p, CAST(trunc(m) AS INTEGER) AS luma FROM g")
def accumulated_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truncated mean of up to four aligned frames."""
    return V.pixels(spark, sf_dir).groupBy("camera_id", F.floor(F.col("frame_id") / 8).alias("window_"), "p").agg(F.avg("luma").cast("int").alias("luma"))


@query(f"{_BANDED}, m AS (SELECT camera_id, band, avg(g) AS m FROM banded GROUP BY ALL), f AS (SELECT b.camera_id, b.p, m, coalesce(lead(band) OVER (PARTITION BY b.camera_id, py ORDER BY px), band) <> band OR coalesce(lead(band) OVER (PARTITION BY b.camera_id, px ORDER BY py), band) <> band AS edge FROM banded b JOIN m USING (camera_id, band)) SELECT camera_id, p, CAST(trunc(CASE WHEN edge THEN m * (1 - 0.45::DOUBLE) ELSE m END) AS INTEGER) AS luma, edge FROM f")
def region_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments filled with their mean, boundaries inked."""
    b = bands(_background(spark, sf_dir))
    right, down = (F.coalesce(F.lead("band").over(Window.partitionBy("camera_id", p).orderBy(o)), F.col("band")) != F.col("band") for p, o in (("py", "px"), ("px", "py")))
    m = b.groupBy("camera_id", "band").agg(F.avg("g").alias("m"))
    f = b.join(m, ["camera_id", "band"]).withColumn("edge", right | down)
    return f.select("camera_id", "p", F.when(F.col("edge"), F.col("m") * (1 - 0.45)).otherwise(F.col("m")).cast("int").alias("luma"), "edge")


_FURN = f"{_BANDED}, boxes(i, fx, fy, fw, fh) AS (VALUES (0, 1, 1, 3, 3), (1, 4, 2, 3, 4))"


@query(f"{_FURN}, s AS (SELECT camera_id, band, i, avg(CASE WHEN px >= fx AND px < fx + fw AND py >= fy AND py < fy + fh THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS share FROM banded, boxes GROUP BY ALL) SELECT camera_id, band, round(max(share), 5) AS furniture FROM s GROUP BY ALL")
def furniture_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greatest share of a segment inside one piece of furniture; the boxes are
    constants of the plan."""
    shares = [F.avg(F.when((F.col("px") >= x) & (F.col("px") < x + w) & (F.col("py") >= y) & (F.col("py") < y + h), 1.0).otherwise(0.0)) for x, y, w, h in ((1, 1, 3, 3), (4, 2, 3, 4))]
    return bands(_background(spark, sf_dir)).groupBy("camera_id", "band").agg(F.round(F.greatest(*shares), 5).alias("furniture"))
