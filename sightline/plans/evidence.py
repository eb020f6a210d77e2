"""Evidence over time: leaky sums, islands, cooldowns, entities, revisions."""

from __future__ import annotations

import datetime
import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.folds import fold
from ..sources import views as V
from .detection import observations
from .registry import query

_D = f"WITH {V.DETECTIONS}"
_R = f"WITH RECURSIVE {V.DETECTIONS}"


@query(f"""{_R}, s AS (SELECT user_id, confidence AS c, k % 4 <> 0 AS hit, row_number() OVER (PARTITION BY user_id ORDER BY ts, det_id) AS n FROM detections), r AS (
  SELECT user_id, n, CASE WHEN hit THEN c ELSE 0.0::DOUBLE END AS e FROM s WHERE n = 1 UNION ALL SELECT s.user_id, s.n, r.e * 0.85::DOUBLE + CASE WHEN hit THEN c ELSE 0.0::DOUBLE END FROM r JOIN s ON s.user_id = r.user_id AND s.n = r.n + 1)
SELECT user_id, round(arg_max(e, n), 6) AS evidence, arg_max(e, n) >= 0.35 AS promoted, max(n) AS passes FROM r GROUP BY user_id""")
def leaky_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence decays each pass and grows by the confidence of a hit."""
    d = V.detections(spark, sf_dir).withColumn("c", F.when(F.col("k") % 4 != 0, F.col("confidence")).otherwise(0.0))
    s = fold(d, ["user_id"], ["ts", "det_id"], ["c"], (0.0, 0), lambda a, r: (a[0] * 0.85 + r.c, a[1] + 1), "user_id long, e double, passes long")
    return s.select("user_id", F.round("e", 6).alias("evidence"), (F.col("e") >= 0.35).alias("promoted"), "passes")


@query(f"""{_D}, s AS (SELECT user_id, det_id, ts, k % 4 <> 0 AS hit, sum(CASE WHEN k % 4 <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, det_id) AS island FROM detections)
SELECT det_id, CASE WHEN hit THEN 0 ELSE CAST(row_number() OVER (PARTITION BY user_id, island, hit ORDER BY ts, det_id) AS INTEGER) END AS misses FROM s""")
def miss_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running misses since the last hit, by islands."""
    hit = F.col("k") % 4 != 0
    d = V.detections(spark, sf_dir).withColumn("hit", hit).withColumn("island", F.sum(F.col("hit").cast("int")).over(Window.partitionBy("user_id").orderBy("ts", "det_id")))
    turn = F.row_number().over(Window.partitionBy("user_id", "island", "hit").orderBy("ts", "det_id"))
    return d.select("det_id", F.when(F.col("hit"), 0).otherwise(turn).alias("misses"))


_WALK = f"{_R}, s AS (SELECT user_id, x::DOUBLE / 20 AS x, y::DOUBLE / 20 AS y, row_number() OVER (PARTITION BY user_id ORDER BY ts, det_id) AS n FROM detections)"


@query(f"""{_WALK}, r AS (SELECT user_id, n, x AS ax, y AS ay, 1 AS moves FROM s WHERE n = 1 UNION ALL
  SELECT s.user_id, s.n, CASE WHEN m THEN s.x ELSE ax END, CASE WHEN m THEN s.y ELSE ay END, moves + CASE WHEN m THEN 1 ELSE 0 END FROM (SELECT r.*, s.x AS nx, s.y AS ny, sqrt((s.x - ax) * (s.x - ax) + (s.y - ay) * (s.y - ay)) > 8 AS m FROM r JOIN s ON s.user_id = r.user_id AND s.n = r.n + 1) q JOIN s ON s.user_id = q.user_id AND s.n = q.n + 1)
SELECT user_id, round(arg_max(ax, n), 4) AS x, round(arg_max(ay, n), 4) AS y, CAST(max(moves) AS BIGINT) AS revision FROM r GROUP BY user_id""")
def anchor_jitter_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A place moves only when a sighting is over 8 from the kept place; each move
    is a revision."""
    d = V.detections(spark, sf_dir).withColumn("px", F.col("x") / 20.0).withColumn("py", F.col("y") / 20.0)

    def step(a, r):
        x, y, n = a
        far = n == 0 or math.sqrt((r.px - x) * (r.px - x) + (r.py - y) * (r.py - y)) > 8
        return (r.px, r.py, n + 1) if far else a

    s = fold(d, ["user_id"], ["ts", "det_id"], ["px", "py"], (None, None, 0), step, "user_id long, x double, y double, revision long")
    return s.select("user_id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), "revision")


@query(f"{_D}, c AS (SELECT det_id, ts, coalesce(k <> lag(k) OVER (PARTITION BY user_id ORDER BY ts, det_id), true) AS changed FROM detections) SELECT det_id, changed, CAST(sum(CASE WHEN changed THEN 1 ELSE 0 END) OVER (PARTITION BY date_trunc('day', ts) ORDER BY ts, det_id) AS BIGINT) AS revision FROM c")
def revision_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running count of changes, here within a day."""
    changed = F.coalesce(F.col("k") != F.lag("k").over(Window.partitionBy("user_id").orderBy("ts", "det_id")), F.lit(True))
    d = V.detections(spark, sf_dir).withColumn("changed", changed)
    return d.select("det_id", "changed", F.sum(F.col("changed").cast("long")).over(Window.partitionBy(F.date_trunc("day", "ts")).orderBy("ts", "det_id")).alias("revision"))


def _gap_fold(d: DataFrame, key: str, kind: str, hours: int) -> DataFrame:
    """``(key, last, sent, held)``: rows let through, for each key, when ``hours`` or
    more have passed since the last such row, and those held back."""
    gap = datetime.timedelta(hours=hours)

    def step(a, r):
        last, sent, held = a
        return (r.ts, sent + 1, held) if last is None or r.ts >= last + gap else (last, sent, held + 1)

    return fold(d, [key], ["ts", "det_id"], [], (None, 0, 0), step, f"{key} {kind}, last timestamp_ntz, sent long, held long")


def _gap_sql(hours: int, source: str) -> str:
    return f"""{_R}, s AS ({source}), r AS (SELECT key, n, ts AS last, 1 AS sent FROM s WHERE n = 1 UNION ALL
  SELECT s.key, s.n, CASE WHEN s.ts >= r.last + INTERVAL {hours} HOUR THEN s.ts ELSE r.last END, r.sent + CASE WHEN s.ts >= r.last + INTERVAL {hours} HOUR THEN 1 ELSE 0 END FROM r JOIN s ON s.key = r.key AND s.n = r.n + 1)"""


@query(_gap_sql(6, "SELECT user_id AS key, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, det_id) AS n FROM detections") + " SELECT key AS user_id, arg_max(last, n) AS last, CAST(max(sent) AS BIGINT) AS passes FROM r GROUP BY key")
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most one pass in six hours a source."""
    return _gap_fold(V.detections(spark, sf_dir), "user_id", "long", 6).select("user_id", "last", F.col("sent").alias("passes"))


_FIRST = "SELECT cls || '/' || CAST(user_id % 10 AS VARCHAR) AS key, ts, row_number() OVER (PARTITION BY cls || '/' || CAST(user_id % 10 AS VARCHAR) ORDER BY ts, det_id) AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id, cls ORDER BY ts, det_id) AS t FROM detections WHERE evidence >= 0.5) WHERE t = 1"


@query(_gap_sql(5, _FIRST) + " SELECT key AS channel, arg_max(last, n) AS last, CAST(max(sent) AS BIGINT) AS sent, CAST(max(n) - max(sent) AS BIGINT) AS held FROM r GROUP BY key")
def notify_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One message for a promoted track, and a cooldown for its class."""
    d = V.detections(spark, sf_dir).where("evidence >= 0.5").withColumn("t", F.row_number().over(Window.partitionBy("user_id", "cls").orderBy("ts", "det_id"))).where("t = 1")
    d = d.withColumn("channel", F.concat_ws("/", "cls", (F.col("user_id") % 10).cast("string")))
    return _gap_fold(d, "channel", "string", 5)


@query(f"{_D}, g AS (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, det_id) AS next_ts FROM detections) SELECT user_id, ts AS missing_from, next_ts AS back_at FROM g WHERE next_ts - ts > INTERVAL 6 HOUR")
def camera_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals without a frame for longer than the limit."""
    g = V.detections(spark, sf_dir).withColumn("next_ts", F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "det_id")))
    return g.where(F.col("next_ts") - F.col("ts") > F.make_dt_interval(hours=F.lit(6))).select("user_id", F.col("ts").alias("missing_from"), F.col("next_ts").alias("back_at"))


@query(f"""{_D}, g AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, det_id) > INTERVAL 6 HOUR, true) AS opens FROM detections), s AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, det_id) AS session FROM g)
SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS beats FROM s GROUP BY user_id, session""")
def heartbeat_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions end when the gap is longer (not equal) than the grace."""
    w = Window.partitionBy("user_id").orderBy("ts", "det_id")
    opens = F.coalesce(F.col("ts") - F.lag("ts").over(w) > F.make_dt_interval(hours=F.lit(6)), F.lit(True))
    g = V.detections(spark, sf_dir).withColumn("opens", opens).withColumn("session", F.sum(F.col("opens").cast("int")).over(w))
    return g.groupBy("user_id", "session").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("beats")).drop("session")


@query(f"""{_D}, g AS (SELECT user_id, ts, det_id, ts - lag(ts) OVER w > INTERVAL 6 HOUR AS missing FROM detections WINDOW w AS (PARTITION BY user_id ORDER BY ts, det_id)), t AS (SELECT *, coalesce(missing, false) AS m, lag(coalesce(missing, false)) OVER (PARTITION BY user_id ORDER BY ts, det_id) AS before FROM g)
SELECT user_id, det_id, m AS missing FROM t WHERE before IS NOT NULL AND m <> before""")
def freshness_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the missing signal only."""
    w = Window.partitionBy("user_id").orderBy("ts", "det_id")
    m = F.coalesce(F.col("ts") - F.lag("ts").over(w) > F.make_dt_interval(hours=F.lit(6)), F.lit(False))
    g = V.detections(spark, sf_dir).withColumn("missing", m).withColumn("before", F.lag("missing").over(w))
    return g.where("before IS NOT NULL AND missing <> before").select("user_id", "det_id", "missing")


@query(_gap_sql(2, "SELECT user_id AS key, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, det_id) AS n FROM detections") + " SELECT key AS user_id, CAST(max(sent) AS BIGINT) AS computed, CAST(max(n) - max(sent) AS BIGINT) AS reused FROM r GROUP BY key")
def cached_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value is computed anew only when the kept one is two hours old."""
    return _gap_fold(V.detections(spark, sf_dir), "user_id", "long", 2).select("user_id", F.col("sent").alias("computed"), F.col("held").alias("reused"))


@query(f"{_D}, c AS (SELECT det_id, user_id, k, row_number() OVER (PARTITION BY user_id ORDER BY ts, det_id) - 1 AS cycle FROM detections) SELECT det_id, round(least(1.0, greatest(0.3, first_value(k) OVER (PARTITION BY user_id, cycle // 30 ORDER BY cycle) / 360.0::DOUBLE)), 5) AS scale FROM c")
def acuity_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A measure taken every thirty cycles and carried between."""
    c = V.detections(spark, sf_dir).withColumn("cycle", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "det_id")) - 1)
    k = F.first("k").over(Window.partitionBy("user_id", F.floor(F.col("cycle") / 30)).orderBy("cycle"))
    return c.select("det_id", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.3), k / 360.0)), 5).alias("scale"))


@query(f"""{_R}, s AS (SELECT user_id AS key, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, det_id) AS n FROM detections), r AS (SELECT key, n, ts AS last, 1 AS since, 0 AS saved FROM s WHERE n = 1 UNION ALL
  SELECT s.key, s.n, CASE WHEN d THEN s.ts ELSE last END, CASE WHEN d THEN 0 ELSE since + 1 END, saved + CASE WHEN d THEN 1 ELSE 0 END FROM (SELECT r.*, r.since + 1 >= 20 OR t.ts >= r.last + INTERVAL 60 HOUR AS d FROM r JOIN s t ON t.key = r.key AND t.n = r.n + 1) q JOIN s ON s.key = q.key AND s.n = q.n + 1)
SELECT key AS user_id, CAST(max(saved) AS BIGINT) AS checkpoints FROM r GROUP BY key""")
def checkpoint_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A checkpoint after so many observations or so long a time."""
    long_ = datetime.timedelta(hours=60)

    def step(a, r):
        last, since, saved = a
        if last is None:
            return r.ts, since + 1, saved
        return (r.ts, 0, saved + 1) if since + 1 >= 20 or r.ts >= last + long_ else (last, since + 1, saved)

    return fold(V.detections(spark, sf_dir), ["user_id"], ["ts", "det_id"], [], (None, 0, 0), step, "user_id long, last timestamp_ntz, since long, checkpoints long").select("user_id", "checkpoints")


_E = f"{_D}, o AS (SELECT *, confidence AS objectness, CASE WHEN confidence >= 0.25 THEN cls END AS klass, x + w / 2.0::DOUBLE AS cx, y + h / 2.0::DOUBLE AS cy FROM detections)"
_ENT = f"""{_E}, e AS (SELECT camera_id, cls, count(*) AS n, avg(cx) AS mx, avg(cy) AS my, avg(w) AS mw, avg(h) AS mh, round_even(sqrt(greatest(0, avg(cx * cx) - avg(cx) * avg(cx))), 1) AS sx, round_even(sqrt(greatest(0, avg(cy * cy) - avg(cy) * avg(cy))), 1) AS sy, min(ts) AS created, max(ts) AS last_seen, count(*) FILTER (objectness > 0) AS hits FROM o GROUP BY camera_id, cls)"""


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Algebraic sums of an entity's observations; partial aggregates, no replay."""
    cx, cy = F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2

    def spread(v):
        return F.bround(F.sqrt(F.greatest(F.lit(0.0), F.avg(v * v) - F.avg(v) * F.avg(v))), 1)

    return observations(spark, sf_dir).groupBy("camera_id", "cls").agg(
        F.count("*").alias("n"), F.avg(cx).alias("mx"), F.avg(cy).alias("my"), F.avg("w").alias("mw"), F.avg("h").alias("mh"), spread(cx).alias("sx"), spread(cy).alias("sy"),
        F.min("ts").alias("created"), F.max("ts").alias("last_seen"), F.count_if(F.col("objectness") > 0).alias("hits"),
    )


@query(f"{_ENT} SELECT camera_id, cls, n, round_even(mx, 1) AS cx, round_even(my, 1) AS cy, round_even(mw, 1) AS w, round_even(mh, 1) AS h, sx, sy, round(sqrt(sx * sx + sy * sy), 4) AS positional_sd, hits FROM e")
def entity_region_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = {n: F.bround(c, 1).alias(n) for n, c in (("cx", "mx"), ("cy", "my"), ("w", "mw"), ("h", "mh"))}
    return entities(spark, sf_dir).select("camera_id", "cls", "n", *r.values(), "sx", "sy", F.round(F.sqrt(F.col("sx") * F.col("sx") + F.col("sy") * F.col("sy")), 4).alias("positional_sd"), "hits")


@query(f"{_E} SELECT user_id, arg_max(klass, (confidence, -det_id)) FILTER (klass IS NOT NULL AND confidence > 0) AS machine_class, round(max(confidence) FILTER (klass IS NOT NULL), 4) AS confidence FROM o GROUP BY user_id")
def entity_best_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of the best confidence so far; an equal one doesn't replace it."""
    named = F.col("klass").isNotNull()
    return observations(spark, sf_dir).groupBy("user_id").agg(F.max_by(F.when(named, F.col("klass")), F.when(named & (F.col("confidence") > 0), F.struct("confidence", -F.col("det_id")))).alias("machine_class"), F.round(F.max(F.when(named, F.col("confidence"))), 4).alias("confidence"))


@query(f"{_D}, r AS (SELECT user_id, det_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, det_id DESC) AS n FROM detections) SELECT user_id, count(*) AS kept, min(det_id) AS lowest, sum(det_id)::BIGINT AS total FROM r WHERE n <= 64 GROUP BY user_id")
def recent_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 64 of an entity, by rank: nothing longer is ever collected."""
    r = V.detections(spark, sf_dir).withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("det_id")))).where("n <= 64")
    return r.groupBy("user_id").agg(F.count("*").alias("kept"), F.min("det_id").alias("lowest"), F.sum("det_id").alias("total"))


def _ladder(key: str) -> str:
    return f"""{_ENT}, l AS (SELECT *, CASE WHEN n >= 50 AND date_diff('second', created, last_seen) >= 600 THEN 'persistent' WHEN n >= 5 THEN 'recurring' ELSE 'transient' END AS state, CASE WHEN n < 5 THEN 'unknown' WHEN sqrt(sx * sx + sy * sy) <= 12 THEN 'static' ELSE 'object' END AS kind FROM (
  SELECT {key} AS owner, cls, count(*) AS n, round_even(sqrt(greatest(0, avg(cx * cx) - avg(cx) * avg(cx))), 1) AS sx, round_even(sqrt(greatest(0, avg(cy * cy) - avg(cy) * avg(cy))), 1) AS sy, min(ts) AS created, max(ts) AS last_seen FROM o GROUP BY {key}, cls))"""


def ladder(spark: SparkSession, sf_dir: str, key: str = "user_id") -> DataFrame:
    """Entities of a source and class with their state and kind."""
    cx, cy = F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2

    def spread(v):
        return F.bround(F.sqrt(F.greatest(F.lit(0.0), F.avg(v * v) - F.avg(v) * F.avg(v))), 1)

    e = observations(spark, sf_dir).groupBy(key, "cls").agg(F.count("*").alias("n"), spread(cx).alias("sx"), spread(cy).alias("sy"), F.min("ts").alias("created"), F.max("ts").alias("last_seen"))
    age = F.unix_timestamp(F.col("last_seen").cast("timestamp")) - F.unix_timestamp(F.col("created").cast("timestamp"))
    state = F.when((F.col("n") >= 50) & (age >= 600), "persistent").when(F.col("n") >= 5, "recurring").otherwise("transient")
    kind = F.when(F.col("n") < 5, "unknown").when(F.sqrt(F.col("sx") * F.col("sx") + F.col("sy") * F.col("sy")) <= 12, "static").otherwise("object")
    return e.withColumn("state", state).withColumn("kind", kind)


@query(f"{_ladder('user_id')} SELECT owner AS user_id, cls, n, state, kind FROM l")
def entity_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ladder(spark, sf_dir).select("user_id", "cls", "n", "state", "kind")


_NOW = "(SELECT max(ts) FROM detections)"


@query(f"{_ladder('user_id')} SELECT owner AS user_id, cls FROM l WHERE NOT (state <> 'persistent' AND owner % 9 <> 0 AND date_diff('second', last_seen, {_NOW}) > 604800)")
def forget_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities neither persistent nor labelled by a user go after a week unseen."""
    now = V.detections(spark, sf_dir).agg(F.max("ts")).scalar()
    age = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col("last_seen").cast("timestamp"))
    gone = (F.col("state") != "persistent") & (F.col("user_id") % 9 != 0) & (age > 604800)
    return ladder(spark, sf_dir).where(~gone).select("user_id", "cls")


@query(f"{_ladder('camera_id')}, p AS (SELECT owner, cls FROM l WHERE state = 'persistent' OR kind = 'static') SELECT cls, count(*) AS n FROM p GROUP BY cls")
def persistent_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ladder(spark, sf_dir, "camera_id").where("state = 'persistent' OR kind = 'static'").groupBy("cls").agg(F.count("*").alias("n"))


@query(f"{_D}, v AS (SELECT camera_id, k // 5 AS revision, det_id FROM detections), f AS (SELECT *, row_number() OVER (PARTITION BY camera_id, revision ORDER BY det_id) AS r FROM v) SELECT camera_id, count(*) FILTER (r = 1) AS renders, count(*) FILTER (r > 1) AS hits FROM f GROUP BY camera_id")
def render_on_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A picture is drawn once for each revision; other reads are cache hits."""
    n = V.detections(spark, sf_dir).groupBy("camera_id", F.floor(F.col("k") / 5).alias("revision")).agg(F.count("*").alias("reads"))
    return n.groupBy("camera_id").agg(F.count("*").alias("renders"), F.sum(F.col("reads") - 1).alias("hits"))


@query(f"{_D}, d AS (SELECT camera_id, date_trunc('day', ts) AS day, avg(abs(k - 50)) AS score FROM detections GROUP BY ALL) SELECT camera_id, CAST(day AS TIMESTAMP) AS day, score > 24 AS stale, coalesce((score > 24) <> lag(score > 24) OVER (PARTITION BY camera_id ORDER BY day), false) AS switched FROM d")
def scene_staleness_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scene joins are off while the picture differs too much from the reference."""
    d = V.detections(spark, sf_dir).groupBy("camera_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(F.avg(F.abs(F.col("k") - 50)).alias("score"))
    stale = F.col("score") > 24
    return d.select("camera_id", "day", stale.alias("stale"), F.coalesce(stale != F.lag(stale).over(Window.partitionBy("camera_id").orderBy("day")), F.lit(False)).alias("switched"))


@query(f"{_D}, {V.REGIONS}, fit AS (SELECT camera_id, avg(CASE WHEN k % 20 <= 10 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS ratio FROM detections GROUP BY camera_id) SELECT camera_id, label, CASE WHEN ratio < 0.5 THEN rx ELSE rx + 5 END AS rx, ratio >= 0.5 AS accepted FROM fit CROSS JOIN regions")
def scene_reregister(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New boxes take the place of the old only if enough matches agree; the
    regions of a scene are few and constants here."""
    fit = V.detections(spark, sf_dir).groupBy("camera_id").agg(F.avg((F.col("k") % 20 <= 10).cast("double")).alias("ratio"))
    rows = F.array(*[F.struct(F.lit(label).alias("label"), F.lit(x).alias("rx")) for label, x, *_ in V.SCENE_REGIONS])
    return fit.withColumn("r", F.explode(rows)).select("camera_id", "r.label", F.when(F.col("ratio") < 0.5, F.col("r.rx")).otherwise(F.col("r.rx") + 5).alias("rx"), (F.col("ratio") >= 0.5).alias("accepted"))


@query(f"{_D}, p AS (SELECT user_id, cls, min(ts) AS ts FROM detections WHERE evidence >= 0.5 GROUP BY user_id, cls) SELECT user_id, cls, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, upper(cls) || ' seen' AS title FROM p WHERE cls IN ('human', 'cat')")
def notified_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A track is announced once, at its first promotion, for selected classes."""
    p = V.detections(spark, sf_dir).where("evidence >= 0.5 AND cls IN ('human', 'cat')").groupBy("user_id", "cls").agg(F.min("ts").alias("ts"))
    return p.select("user_id", "cls", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), F.concat(F.upper("cls"), F.lit(" seen")).alias("title"))
