"""Settings and control tables: parsing, validation, filter chains, status."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources import views as V
from .registry import query

_S = f"WITH {V.SETTINGS}"
_N = f"WITH {V.NOTCHES}"


@query(f"{_S} SELECT i, coalesce(try_cast(value AS DOUBLE), 12.5::DOUBLE) AS as_double, CAST(trunc(coalesce(try_cast(value AS DOUBLE), 7)) AS INTEGER) AS as_int FROM settings")
def typed_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers with a default where the text is none."""
    return V.settings(spark, sf_dir).select("i", X.as_double(F.col("value"), 12.5).alias("as_double"), X.as_int(F.col("value"), 7).alias("as_int"))


_LINES = "lines AS (SELECT p_partkey AS i, CASE p_partkey % 5 WHEN 0 THEN '# note' WHEN 1 THEN '' WHEN 2 THEN 'SIZE=' || CAST(p_size * 10 AS VARCHAR) || 'x' || CAST(p_size * 5 AS VARCHAR) WHEN 3 THEN 'KEY' || CAST(p_size AS VARCHAR) || '=a=b' ELSE ' GAIN = 3 ' END AS line FROM part)"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey") % 5, F.col("p_size")
    line = F.when(k == 0, "# note").when(k == 1, "").when(k == 2, F.concat(F.lit("SIZE="), (s * 10).cast("string"), F.lit("x"), (s * 5).cast("string"))).when(k == 3, F.concat(F.lit("KEY"), s.cast("string"), F.lit("=a=b"))).otherwise(" GAIN = 3 ")
    return V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("i"), line.alias("line"))


@query(f"WITH {_LINES} SELECT i, trim(substr(trim(line), 1, strpos(trim(line), '=') - 1)) AS key, trim(substr(trim(line), strpos(trim(line), '=') + 1)) AS value FROM lines WHERE trim(line) <> '' AND NOT starts_with(trim(line), '#') AND strpos(line, '=') > 0")
def config_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``KEY=VALUE`` lines, split at the first sign; blanks and comments skipped."""
    line = F.trim("line")
    kept = _lines(spark, sf_dir).where((line != "") & ~F.startswith(line, F.lit("#")) & F.contains(line, F.lit("="))).withColumn("kv", F.split(line, "=", 2))
    return kept.select("i", F.trim(F.col("kv")[0]).alias("key"), F.trim(F.col("kv")[1]).alias("value"))


@query("""WITH t AS (SELECT p_partkey AS i, CASE p_partkey % 4 WHEN 0 THEN '640X480' WHEN 1 THEN CAST(p_size AS VARCHAR) || 'x' WHEN 2 THEN '0x100' ELSE CAST(p_size * 20 AS VARCHAR) || 'x' || CAST(p_size * 10 AS VARCHAR) END AS v FROM part),
p AS (SELECT i, try_cast(split_part(lower(v), 'x', 1) AS INTEGER) AS w, try_cast(split_part(lower(v), 'x', 2) AS INTEGER) AS h FROM t) SELECT i, CASE WHEN w > 0 AND h > 0 THEN w ELSE 1280 END AS w, CASE WHEN w > 0 AND h > 0 THEN h ELSE 720 END AS h FROM p""")
def frame_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey") % 4, F.col("p_size")
    v = F.lower(F.when(k == 0, "640X480").when(k == 1, F.concat(s.cast("string"), F.lit("x"))).when(k == 2, "0x100").otherwise(F.concat((s * 20).cast("string"), F.lit("x"), (s * 10).cast("string"))))
    w, h = (F.split_part(v, F.lit("x"), F.lit(n)).try_cast("int") for n in (1, 2))
    sound = F.coalesce((w > 0) & (h > 0), F.lit(False))
    return V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("i"), F.when(sound, w).otherwise(1280).alias("w"), F.when(sound, h).otherwise(720).alias("h"))


# Settings that may be overridden, with their defaults.
TUNABLES = {"iou": 0.3, "recent": 64.0, "promote": 50.0, "forget": 604800.0}


@query(f"""WITH d(key, dflt) AS (VALUES {", ".join(f"('{k}', {v}::DOUBLE)" for k, v in TUNABLES.items())}), o AS (SELECT p_partkey % 100 AS grp, CASE p_partkey % 5 WHEN 0 THEN 'iou' WHEN 1 THEN 'recent' WHEN 2 THEN 'other' WHEN 3 THEN 'promote' ELSE 'forget' END AS key, max(CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size END) AS v FROM part GROUP BY ALL)
SELECT grp, key, coalesce(CAST(v AS DOUBLE), dflt) AS value FROM (SELECT DISTINCT grp FROM o) g CROSS JOIN d LEFT JOIN o USING (grp, key)""")
def config_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defaults under overrides; unknown keys are ignored. The defaults are a
    constant, so each group makes its own rows."""
    k = F.col("p_partkey") % 5
    key = F.when(k == 0, "iou").when(k == 1, "recent").when(k == 2, "other").when(k == 3, "promote").otherwise("forget")
    o = V.table(spark, sf_dir, "part").groupBy((F.col("p_partkey") % 100).alias("grp"), key.alias("key")).agg(F.max(F.when(F.col("p_size") % 7 != 0, F.col("p_size"))).alias("v"))
    rows = F.array(*[F.struct(F.lit(n).alias("key"), F.lit(d).alias("dflt")) for n, d in TUNABLES.items()])
    base = o.select("grp").distinct().withColumn("d", F.explode(rows)).select("grp", "d.key", "d.dflt")
    return base.join(o, ["grp", "key"], "left").select("grp", "key", F.coalesce(F.col("v").cast("double"), "dflt").alias("value"))


_C = "least(greatest(try_cast(value AS DOUBLE), {0}), {1})"


@query(f"""{_S} SELECT i, CAST(round_even({_C.format(0, 1000)}, 0) AS INTEGER) AS highpass, CAST(round_even({_C.format(1000, 24000)}, 0) AS INTEGER) AS lowpass, round_even(least(greatest(try_cast(value AS DOUBLE) / 100, -20), 30), 1) AS gain, CASE WHEN try_cast(value AS DOUBLE) IS NULL THEN 'ignored' ELSE 'ok' END AS verdict FROM settings""")
def settings_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return V.settings(spark, sf_dir).select("i", X.clamped(v, 0, 1000, 0).alias("highpass"), X.clamped(v, 1000, 24000, 0).alias("lowpass"), X.clamped((v.try_cast("double") / 100).cast("string"), -20, 30, 1).alias("gain"), F.when(v.try_cast("double").isNull(), "ignored").otherwise("ok").alias("verdict"))


@query("SELECT p_partkey AS i, p_size % 2 = 0 AS kept FROM part WHERE p_size % 2 = 0")
def settings_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitelisted keys with a value are written, others dropped."""
    m = F.create_map(F.lit("gain"), F.when(F.col("p_size") % 2 == 0, "3").otherwise(""), F.lit("other"), F.lit("x"))
    kept = F.map_filter(m, lambda k, v: k.isin("gain", "highpass") & (v != ""))
    return V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("i"), (F.size(F.map_keys(kept)) == 1).alias("kept")).where("kept")


_FILTER = "CASE WHEN lo IS NOT NULL AND hi IS NOT NULL THEN CASE WHEN (lo + hi) / 2 > 0 AND hi - lo > 0 THEN printf('bandreject=f=%.1f:t=h:w=%.1f', (lo + hi) / 2, hi - lo) END ELSE CASE WHEN center > 0 AND coalesce(width, 20.0) > 0 THEN printf('bandreject=f=%.1f:t=h:w=%.1f', center, coalesce(width, 20.0)) END END"


@query(f"{_N} SELECT i, {_FILTER} AS filter FROM notches WHERE coalesce(enabled, true) AND {_FILTER} IS NOT NULL")
def notch_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands that are on and sound; malformed ones are left out."""
    f = X.notch(*map(F.col, ("center", "width", "lo", "hi")))
    return V.notches(spark, sf_dir).where(F.coalesce("enabled", F.lit(True))).select("i", f.alias("filter")).where("filter IS NOT NULL")


@query(f"""{_N} SELECT i, coalesce(CASE WHEN lo IS NOT NULL THEN lo >= 20 AND lo < hi AND hi <= 20000 ELSE center >= 20 AND center <= 20000 AND width >= 1 AND width <= 500 END, false) AS accepted, left(trim(coalesce(nullif(note, ''), 'added')), 12) AS note FROM notches""")
def notch_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    lo, hi, c, w = map(F.col, ("lo", "hi", "center", "width"))
    sound = F.when(lo.isNotNull(), (lo >= 20) & (lo < hi) & (hi <= 20000)).otherwise(c.between(20, 20000) & w.between(1, 500))
    return V.notches(spark, sf_dir).select("i", F.coalesce(sound, F.lit(False)).alias("accepted"), F.left(F.trim(F.coalesce(F.nullif("note", F.lit("")), F.lit("added"))), F.lit(12)).alias("note"))


@query(f"{_N} SELECT i, coalesce((lo + hi) / 2, center, 0) AS centre FROM notches")
def notch_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.coalesce((F.col("lo") + F.col("hi")) / 2, "center", F.lit(0.0))
    return V.notches(spark, sf_dir).select("i", c.alias("centre")).orderBy("centre", "i")


_GAIN = "CAST((i % 7 - 3) * 2 AS INTEGER)"


@query(f"""{_N}, f AS (SELECT i % 20 AS chain, string_agg({_FILTER}, ',' ORDER BY i) AS notches FROM notches WHERE coalesce(enabled, true) GROUP BY ALL), k AS (SELECT DISTINCT i % 20 AS i FROM notches)
SELECT k.i AS chain, concat_ws(',', notches, CASE WHEN k.i % 4 <> 0 THEN repeat('highpass=f=' || CAST(60 + k.i * 10 AS VARCHAR) || ',', CAST(k.i % 3 AS INTEGER)) || 'highpass=f=' || CAST(60 + k.i * 10 AS VARCHAR) END, CASE WHEN k.i % 5 <> 0 THEN 'lowpass=f=14000' END, CASE WHEN {_GAIN.replace('i %', 'k.i %')} <> 0 THEN 'volume=' || CAST({_GAIN.replace('i %', 'k.i %')} AS VARCHAR) || 'dB' END, 'alimiter=limit=0.95') AS filters FROM k LEFT JOIN f ON f.chain = k.i""")
def monitor_filter_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole filter chain of a monitor, from its bands and settings."""
    n = V.notches(spark, sf_dir).withColumn("chain", F.col("i") % 20)
    f = F.when(F.coalesce("enabled", F.lit(True)), X.notch(*map(F.col, ("center", "width", "lo", "hi"))))
    bands = n.groupBy("chain").agg(F.transform(F.array_sort(F.collect_list(F.when(f.isNotNull(), F.struct("i", f.alias("f"))))), lambda s: s["f"]).alias("bands"))
    c = F.col("chain")
    high = F.when(c % 4 == 0, "off").otherwise((c * 10 + 60).cast("string"))
    low = F.when(c % 5 == 0, "off").otherwise("14000")
    return bands.select("chain", X.monitor_chain(F.col("bands"), high, (c % 3 + 1).cast("string"), low, F.lit("1"), ((c % 7 - 3) * 2).cast("int")).alias("filters"))


@query("""WITH t AS (SELECT p_partkey AS i, CASE p_partkey % 3 WHEN 0 THEN 'off' WHEN 1 THEN '' ELSE 'custom=1' END AS l, CASE p_partkey % 4 WHEN 0 THEN 'off' WHEN 1 THEN 'highpass=f=200' ELSE NULL END AS b, CASE p_partkey % 5 WHEN 0 THEN '0' WHEN 1 THEN '' ELSE '-9' END AS g, CASE WHEN p_partkey % 6 = 0 THEN 'on' ELSE '0' END AS m FROM part)
SELECT i, coalesce(nullif(concat_ws(',', CASE WHEN l <> 'off' THEN coalesce(nullif(l, ''), 'speechnorm=p=0.95:e=12.5:c=2:t=0.02') END, CASE WHEN coalesce(b, '') <> 'off' THEN coalesce(b, 'highpass=f=150,lowpass=f=3800') END, CASE WHEN g <> '0' THEN 'volume=' || coalesce(nullif(g, ''), '-15') || 'dB' END, CASE WHEN m = 'on' THEN 'volume=0' END), ''), 'volume=0dB') AS filters FROM t""")
def talk_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("p_partkey")
    level = F.when(i % 3 == 0, "off").when(i % 3 == 1, "").otherwise("custom=1")
    band = F.when(i % 4 == 0, "off").when(i % 4 == 1, "highpass=f=200")
    gain = F.when(i % 5 == 0, "0").when(i % 5 == 1, "").otherwise("-9")
    return V.table(spark, sf_dir, "part").select(i.alias("i"), X.talk_chain(level, band, gain, F.when(i % 6 == 0, "on").otherwise("0")).alias("filters"))


@query("""WITH t AS (SELECT p_partkey AS i, CASE p_partkey % 6 WHEN 0 THEN ' CLOAK ' WHEN 1 THEN 'hide' WHEN 2 THEN 'night' WHEN 3 THEN 'cv' WHEN 4 THEN 'bogus' END AS v FROM part), n AS (SELECT i, v, CASE lower(trim(v)) WHEN 'cloak' THEN 'cv' ELSE lower(trim(v)) END AS m FROM t)
SELECT i, CASE WHEN m IN ('hide', 'cv', 'night', 'normal') THEN m ELSE 'hide' END AS mode, coalesce(m IN ('hide', 'cv', 'night', 'normal'), false) AS accepted FROM n""")
def mode_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases become their mode; unknown and unreadable ones hide."""
    k = F.col("p_partkey") % 6
    v = F.when(k == 0, " CLOAK ").when(k == 1, "hide").when(k == 2, "night").when(k == 3, "cv").when(k == 4, "bogus")
    m = F.lower(F.trim(v))
    m = F.when(m == "cloak", "cv").otherwise(m)
    known = F.coalesce(m.isin("hide", "cv", "night", "normal"), F.lit(False))
    return V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("i"), F.when(known, m).otherwise("hide").alias("mode"), known.alias("accepted"))


@query("SELECT p_partkey AS i, CASE p_partkey % 6 WHEN 0 THEN true WHEN 3 THEN true WHEN 5 THEN true ELSE false END AS on_ FROM part")
def truthy_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 6
    v = F.when(k == 0, "1").when(k == 1, " No ").when(k == 2, "false").when(k == 3, "yes").when(k == 4, "")
    return V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("i"), X.flag(v, missing=True).alias("on_"))


@query("SELECT s_suppkey AS i, '10.0.0.' || CAST(s_suppkey % 250 AS VARCHAR) AS ip FROM supplier WHERE s_suppkey % 3 = 0 AND s_suppkey % 10 <> 0 AND s_suppkey % 7 <> 0")
def pinned_cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pinned cameras with an address, without those dropped this session."""
    s = F.col("s_suppkey")
    cams = V.table(spark, sf_dir, "supplier").select(s.alias("i"), (s % 3 == 0).alias("pinned"), F.when(s % 10 == 0, "").otherwise(F.concat(F.lit("10.0.0."), (s % 250).cast("string"))).alias("ip"))
    dropped = cams.where("i % 7 = 0").select("i")
    return cams.where("pinned AND ip <> ''").join(dropped, "i", "left_anti").select("i", "ip")


@query("SELECT p_partkey AS i, CAST(CASE WHEN p_partkey % 3 = 0 THEN '96' ELSE CAST(p_size * 8 AS VARCHAR) END AS INTEGER) AS kbps FROM part")
def bitrate_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.when(F.col("p_partkey") % 3 == 0, "96k").otherwise(F.concat((F.col("p_size") * 8).cast("string"), F.lit("K")))
    return V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("i"), F.regexp_replace(v, "[kK]+$", "").cast("int").alias("kbps"))


@query("""WITH t AS (SELECT p_partkey AS i, unnest(['Capture=' || CAST(p_size AS VARCHAR), 'Boost=2', 'junk']) AS part, p_partkey % 2 = 0 AS muted FROM part) SELECT i, trim(split_part(part, '=', 1)) AS control, trim(split_part(part, '=', 2)) AS value FROM t WHERE strpos(part, '=') > 0 AND NOT (muted AND strpos(lower(part), 'boost') > 0)""")
def mixer_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``A=1,B=2``; parts without a sign are skipped, boosts too while muted."""
    spec = F.concat(F.lit("Capture="), F.col("p_size").cast("string"), F.lit(", Boost=2,junk"))
    t = V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("i"), F.explode(F.split(spec, ",")).alias("part"), (F.col("p_partkey") % 2 == 0).alias("muted"))
    kept = t.where(F.contains("part", F.lit("=")) & ~(F.col("muted") & F.contains(F.lower("part"), F.lit("boost"))))
    return kept.select("i", F.trim(F.split_part("part", F.lit("="), F.lit(1))).alias("control"), F.trim(F.split_part("part", F.lit("="), F.lit(2))).alias("value"))


@query("""SELECT s_suppkey AS i, 'Mic' || CAST(s_suppkey % 4 AS VARCHAR) AS card, CAST(s_suppkey % 3 AS INTEGER) AS device, CASE WHEN s_suppkey % 2 = 0 THEN '100.64.0.' || CAST(s_suppkey % 200 AS VARCHAR) ELSE '' END AS address, s_suppkey % 5 = 0 AS established FROM supplier""")
def probe_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts read out of the lines of system probes."""
    s = F.col("s_suppkey")
    line = F.concat(F.lit("plughw:CARD=Mic"), (s % 4).cast("string"), F.lit(",DEV="), (s % 3).cast("string"))
    address = F.when(s % 2 == 0, F.concat(F.lit("inet 100.64.0."), (s % 200).cast("string"), F.lit("/32"))).otherwise("inet 10.1.1.1/8")
    socket = F.concat(F.lit("  1: 0100007F:216A 0100007F:C350 "), F.when(s % 5 == 0, "01").otherwise("06"), F.lit(" 0"))
    fields = F.split(F.trim(socket), " +")
    return V.table(spark, sf_dir, "supplier").select(s.alias("i"), F.regexp_extract(line, r"CARD=(\w+)", 1).alias("card"), F.regexp_extract(line, r"DEV=(\d+)", 1).cast("int").alias("device"), F.regexp_extract(address, r"\b(100(?:\.\d+){3})\b", 1).alias("address"), ((fields[3] == "01") & F.endswith(fields[1], F.lit(":216A"))).alias("established"))


@query(f"WITH {V.DETECTIONS} SELECT det_id, printf('%s %d%% (evidence %.2f)', cls, CAST(round_even(confidence * 100, 0) AS INTEGER), floor(evidence * 100 + 0.5::DOUBLE) / 100) AS body, upper(cls) || ' detected' AS title, strftime(ts, '%Y-%m-%d') AS day, epoch_us(ts) // 1000 AS millis FROM detections")
def notification_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.format_string("%s %d%% (evidence %.2f)", "cls", F.bround(F.col("confidence") * 100, 0).cast("int"), F.floor(F.col("evidence") * 100 + 0.5) / 100.0)
    return V.detections(spark, sf_dir).select("det_id", body.alias("body"), F.concat(F.upper("cls"), F.lit(" detected")).alias("title"), F.date_format("ts", "yyyy-MM-dd").alias("day"), F.unix_millis(F.col("ts").cast("timestamp")).alias("millis"))


@query("SELECT c_custkey AS i, replace(replace(replace('<' || c_name || '> & ' || c_mktsegment, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS safe, left(trim('  ' || c_name || c_mktsegment || '  '), 20) AS short FROM customer")
def safe_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("<"), "c_name", F.lit("> & "), "c_mktsegment")
    return V.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("i"), X.escaped(raw).alias("safe"), F.left(F.trim(F.concat(F.lit("  "), "c_name", "c_mktsegment", F.lit("  "))), F.lit(20)).alias("short"))


@query("SELECT n_regionkey AS region, md5(string_agg('10.0.0.' || CAST(n_nationkey AS VARCHAR) || n_name, '|' ORDER BY n_nationkey)) AS digest, count(*) AS cameras FROM nation GROUP BY n_regionkey")
def config_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of a camera list in order, to see whether it changed."""
    part = F.concat(F.lit("10.0.0."), F.col("n_nationkey").cast("string"), "n_name")
    rows = F.array_sort(F.collect_list(F.struct("n_nationkey", part.alias("p"))))
    return V.table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.md5(F.array_join(F.transform(rows, lambda r: r["p"]), "|")).alias("digest"), F.count("*").alias("cameras"))


@query("""SELECT o_orderkey AS i, CASE WHEN o_orderkey % 3 = 0 THEN 'off' WHEN o_orderkey % 5 < 3 THEN 'ok' ELSE 'down' END AS camera, CASE WHEN o_orderkey % 4 = 0 THEN 'disabled' WHEN o_orderkey % 7 = 0 THEN 'down' ELSE 'ok' END AS mic, CASE WHEN o_orderkey % 4 = 0 THEN 'disabled' WHEN o_orderkey % 3 = 0 THEN 'off' ELSE 'ok' END AS audio,
CASE WHEN o_orderkey % 6 = 0 THEN 'unregistered' WHEN o_orderkey % 6 < 3 THEN 'stale' ELSE 'registered' END AS scene FROM orders""")
def status_lamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-valued lamps: a thing switched off isn't a fault."""
    i = F.col("o_orderkey")
    hidden, fresh, enabled, card, known, stale = i % 3 == 0, i % 5 < 3, i % 4 != 0, i % 7 != 0, i % 6 != 0, i % 6 < 3
    return V.table(spark, sf_dir, "orders").select(
        i.alias("i"), F.when(hidden, "off").when(fresh, "ok").otherwise("down").alias("camera"), F.when(~enabled, "disabled").when(~card, "down").otherwise("ok").alias("mic"),
        F.when(~enabled, "disabled").when(hidden, "off").otherwise("ok").alias("audio"), F.when(~known, "unregistered").when(stale, "stale").otherwise("registered").alias("scene"),
    )


@query("""WITH b AS (SELECT c_custkey AS i, -20 - (c_custkey * 7 % 70) AS a, -20 - (c_custkey * 11 % 60) AS d FROM customer) SELECT i, CASE WHEN a < -70 THEN 'dead' WHEN a < -55 THEN 'weak' ELSE 'ok' END AS verdict, a < -70 AND d > a + 20 AS dc_note FROM b""")
def audio_band_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, d = F.lit(-20) - F.col("c_custkey") * 7 % 70, F.lit(-20) - F.col("c_custkey") * 11 % 60
    return V.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("i"), F.when(a < -70, "dead").when(a < -55, "weak").otherwise("ok").alias("verdict"), ((a < -70) & (d > a + 20)).alias("dc_note"))


@query(f"""WITH {V.DETECTIONS}, m AS (SELECT user_id % 20 AS slot, arg_max('note ' || CAST(k AS VARCHAR), (ts, det_id)) FILTER (k % 3 <> 0) AS message, max(ts) FILTER (k % 3 <> 0) AS noted, count(*) FILTER (k % 2 = 0) % 2 = 1 AS locked FROM detections GROUP BY ALL)
SELECT slot, coalesce(message, 'none') AS message, noted, locked FROM m""")
def text_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current text of a slot is its newest; a lock toggles."""
    k = F.col("k")
    text = F.when(k % 3 != 0, F.concat(F.lit("note "), k.cast("string")))
    return V.detections(spark, sf_dir).groupBy((F.col("user_id") % 20).alias("slot")).agg(
        F.coalesce(F.max_by(text, F.when(k % 3 != 0, F.struct("ts", "det_id"))), F.lit("none")).alias("message"), F.max(F.when(k % 3 != 0, F.col("ts"))).alias("noted"), (F.count_if(k % 2 == 0) % 2 == 1).alias("locked"),
    )


@query("""SELECT s_suppkey AS i, CASE WHEN s_suppkey % 3 = 0 THEN s_name WHEN s_suppkey % 3 = 1 THEN 'CAT' ELSE 'STATIC ' || upper(left(substr(md5(CAST(s_suppkey AS VARCHAR)), 1, 12), 4)) END AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'etc' ELSE 'share' END AS identity FROM supplier""")
def display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's label before the machine's class before kind and short id."""
    s = F.col("s_suppkey")
    label, klass = F.when(s % 3 == 0, F.col("s_name")), F.when(s % 3 == 1, "cat")
    key = F.concat(F.lit("e-"), F.substring(F.md5(s.cast("string")), 1, 12))
    short = F.upper(F.left(F.substring_index(key, "-", -1), F.lit(4)))
    name = F.coalesce(F.nullif(label, F.lit("")), F.upper(klass), F.concat(F.lit("STATIC "), short))
    return V.table(spark, sf_dir, "supplier").select(s.alias("i"), name.alias("name"), F.coalesce(F.when(s % 2 == 0, "etc"), F.lit("share")).alias("identity"))


@query("SELECT p_partkey AS i, 'CV' || CASE WHEN p_size % 2 = 0 THEN ' / GRID' ELSE '' END || CASE WHEN p_size % 3 = 0 THEN ' / SCENE' ELSE '' END || CASE WHEN p_size % 5 = 0 THEN ' / DETECT' ELSE '' END AS capability FROM part")
def capability_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("p_size")
    return V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("i"), F.concat_ws(" / ", F.lit("CV"), F.when(s % 2 == 0, "GRID"), F.when(s % 3 == 0, "SCENE"), F.when(s % 5 == 0, "DETECT")).alias("capability"))


@query(f"WITH {V.DETECTIONS} SELECT det_id, cls AS kind, x, 'none' AS facing FROM detections")
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records to JSON and back by an explicit schema; absent keys get defaults."""
    j = F.to_json(F.struct(F.col("det_id"), F.col("cls").alias("kind"), F.col("x")))
    back = F.from_json(j, "det_id BIGINT, kind STRING, x INT, facing DOUBLE")
    return V.detections(spark, sf_dir).select(back.alias("r")).select("r.det_id", "r.kind", "r.x", F.coalesce(F.col("r.facing").cast("string"), F.lit("none")).alias("facing"))
