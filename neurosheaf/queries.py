"""The registered queries of the signal operators over the driver's tables, each with DuckDB's SQL where SQL can express it.

Views of the tables as signals:

- ``sig``: lineitem; a supplier is a recording, four measures (price in thousands) are its channels, rows in order of all columns its samples (100 Hz).
- ``ep``: embeddings; a vector is a recording with one channel of 64 samples (64 Hz), its label the condition.
- ``cap``: embeddings; a label is a recording, positions are its 64 channels, vectors its samples.
- ``ann``: events; a user is a recording, events are its annotations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import montage, names
from .operators import annotations, artifacts, bad_channels, channels, connectivity, epochs, features, filtering, ica, quality, ranking, signals, spatial, spectral, statistics, windowing
from .plans import report
from .plans.pipeline import Pipeline
from .session import kept, shared_folder, ship
from .sources import files
from .sources.simulate import simulate
from .streaming import causal

RATE, CHANNELS = 100.0, ["disc", "price", "qty", "tax"]
#: Rows of lineitem a task, about: what a task sorts is then bounded, whatever the size of the table.
TASK_ROWS = 200_000
_ORDER = ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def sig(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Named before the window, so that Spark knows the rows as dealt out by recording, and groups channels or samples where they are.
    table = _read(spark, sf_dir, "lineitem")
    # Parquet files tell their numbers of rows.
    tasks = max(table.count() // TASK_ROWS, spark.sparkContext.defaultParallelism)
    rows = table.withColumnRenamed("l_suppkey", "recording").repartition(tasks, "recording")
    # Rows that are alike up to the four measures have the same values, so what comes after in the order can't change a sample, and isn't shuffled.
    place = F.row_number().over(W.partitionBy("recording").orderBy(*_ORDER[:7])) - 1
    wide = rows.select("recording", place.cast("long").alias("sample"), F.col("l_discount").alias("disc"), (F.col("l_extendedprice") / 1000).alias("price"), F.col("l_quantity").alias("qty"), F.col("l_tax").alias("tax"))
    return signals.melt(wide, CHANNELS)


def ep(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("recording"), F.lit("e").alias("channel"), "label", F.posexplode("embedding").alias("sample", "v"))
    return long.select("recording", "channel", F.col("sample").cast("long").alias("sample"), F.col("v").cast("double").alias("value"), F.col("label").cast("string").alias("condition"))


def cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = (F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1).cast("long")
    numbered = _read(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("recording"), place.alias("sample"), "embedding")
    placed = numbered.select("recording", "sample", F.posexplode("embedding").alias("i", "v"))
    return placed.select("recording", F.format_string("c%02d", "i").alias("channel"), "sample", F.col("v").cast("double").alias("value"))


def ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    first = F.min(at).over(W.partitionBy("user_id"))
    return _read(spark, sf_dir, "events").select(F.col("user_id").alias("recording"), ((at - first) / 1e6).alias("onset"), (F.col("value") / 10).alias("duration"), F.col("event_type").alias("description"))


_WIDE = f"SELECT l_suppkey AS recording, row_number() OVER (PARTITION BY l_suppkey ORDER BY {', '.join(_ORDER)}) - 1 AS sample, l_discount AS disc, l_extendedprice / 1000 AS price, l_quantity AS qty, l_tax AS tax FROM lineitem"
SIG = f"wide AS ({_WIDE}), sig AS (" + " UNION ALL ".join(f"SELECT recording, '{c}' AS channel, sample, CAST({c} AS DOUBLE) AS value FROM wide" for c in CHANNELS) + ")"
_PLACES = "(SELECT unnest(range(64)) AS i)"
EP = f"ep AS (SELECT vec_id AS recording, 'e' AS channel, i AS sample, CAST(embedding[i + 1] AS DOUBLE) AS value, CAST(label AS VARCHAR) AS condition FROM embeddings, {_PLACES})"
CAP = f"cap AS (SELECT CAST(label AS BIGINT) AS recording, 'c' || lpad(CAST(i AS VARCHAR), 2, '0') AS channel, place AS sample, CAST(embedding[i + 1] AS DOUBLE) AS value FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS place FROM embeddings), {_PLACES})"
ANN = "ann AS (SELECT user_id AS recording, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6 AS onset, value / 10 AS duration, event_type AS description FROM events)"


def r6(x: str) -> str:
    return f"(round({x}, 6) + 0.0)"


def tidy(df: DataFrame) -> DataFrame:
    """Doubles to six places, whole numbers as long."""
    kinds = dict(df.dtypes)
    value = {"double": lambda c: F.round(c, 6), "float": lambda c: F.round(c.cast("double"), 6), "int": lambda c: c.cast("long"), "smallint": lambda c: c.cast("long")}
    return df.select(*(value.get(kinds[c], lambda x: x)(F.col(c)).alias(c) for c in df.columns))


QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: (ship(spark), tidy(f(spark, sf_dir)))[1]
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


# Tables and robust statistics

@register("channel_table", f"WITH {SIG} SELECT recording, channel, count(*) AS n, {r6('avg(value)')} AS mean, {r6('stddev_pop(value)')} AS std, min(value) AS min, max(value) AS max, CAST(count(*) - count(value) AS BIGINT) AS n_missing FROM sig GROUP BY ALL")
def _(spark, d):
    return statistics.channel_table(sig(spark, d))


@register("robust_statistics", f"WITH {SIG}, m AS (SELECT recording, channel, median(value) AS median FROM sig GROUP BY ALL) SELECT recording, channel, {r6('m.median')} AS median, {r6('1.4826 * median(abs(value - m.median))')} AS mad, {r6('0.7413 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25))')} AS robust_std FROM sig JOIN m USING (recording, channel) GROUP BY recording, channel, m.median")
def _(spark, d):
    s = sig(spark, d)
    return statistics.mad(s, signals.KEY).join(s.groupBy(*signals.KEY).agg(statistics.robust_std(F.col("value")).alias("robust_std")), signals.KEY)


@register("robust_z", f"""WITH {SIG}, l AS (SELECT recording, channel, log10(stddev_pop(value)) AS level FROM sig GROUP BY ALL),
m AS (SELECT *, median(level) OVER (PARTITION BY channel) AS m FROM l), a AS (SELECT *, 1.4826 * median(abs(level - m)) OVER (PARTITION BY channel) AS mad, stddev_pop(level) OVER (PARTITION BY channel) AS sd FROM m)
SELECT recording, channel, {r6('level')} AS level, {r6("coalesce((level - m) / CASE WHEN mad > 1e-12 THEN mad WHEN sd > 1e-12 THEN sd END, 0.0)")} AS z FROM a""")
def _(spark, d):
    level = sig(spark, d).groupBy(*signals.KEY).agg(F.log10(F.stddev_pop("value")).alias("level"))
    return statistics.robust_z(level, ["channel"], "level")


_N = "CAST(count(*) AS DOUBLE)"
@register("moments", f"""WITH {SIG}, m AS (SELECT recording, channel, avg(value) AS mu, {_N} AS n FROM sig GROUP BY ALL),
c AS (SELECT recording, channel, n, avg((value - mu) ** 2) AS m2, avg((value - mu) ** 3) AS m3, avg((value - mu) ** 4) AS m4 FROM sig JOIN m USING (recording, channel) GROUP BY recording, channel, n)
SELECT recording, channel, {r6('m3 / m2 ** 1.5')} AS skewness, {r6('m4 / m2 ** 2 - 3')} AS kurtosis, {r6('CASE WHEN n > 3 THEN (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (m4 / m2 ** 2 - 3) + 6) END')} AS excess_kurtosis FROM c""")
def _(spark, d):
    return statistics.moments(sig(spark, d))


# Windows, runs and intervals

def _windows(length: int, view: str = "sig") -> str:
    return f"w AS (SELECT recording, channel, sample // {length} AS win, stddev_pop(value) AS std, max(value) - min(value) AS ptp FROM {view} GROUP BY ALL HAVING count(*) = {length})"


@register("window_table", f"WITH {SIG}, {_windows(25)} SELECT recording, channel, CAST(win AS BIGINT) AS \"window\", {r6('std')} AS std, {r6('ptp')} AS ptp FROM w")
def _(spark, d):
    return windowing.window_table(sig(spark, d), 25)


@register("flat_fraction", f"WITH {SIG}, {_windows(5)} SELECT recording, channel, {r6('avg(CASE WHEN std < 0.0205 THEN 1.0 ELSE 0.0 END)')} AS flat_fraction FROM w GROUP BY ALL")
def _(spark, d):
    return windowing.flat_fraction(windowing.window_table(sig(spark, d), 5), 0.0205)


@register("amplitude_instability", f"""WITH {SIG}, {_windows(10)}, l AS (SELECT recording, channel, log10(greatest(std, 1e-6)) AS l FROM w), m AS (SELECT *, median(l) OVER (PARTITION BY recording, channel) AS m FROM l)
SELECT recording, channel, {r6('CASE WHEN count(*) < 3 THEN 0.0 ELSE 1.4826 * median(abs(l - m)) END')} AS instability FROM m GROUP BY ALL""")
def _(spark, d):
    return windowing.amplitude_instability(windowing.window_table(sig(spark, d), 10))


@register("bad_window_fraction", f"""WITH {SIG}, {_windows(10)}, l AS (SELECT *, log10(greatest(std, 1e-6)) AS l FROM w), m AS (SELECT *, median(l) OVER p AS m, count(*) OVER p AS peers FROM l WINDOW p AS (PARTITION BY recording, win)),
s AS (SELECT *, 1.4826 * median(abs(l - m)) OVER (PARTITION BY recording, win) AS spread FROM m)
SELECT recording, channel, {r6('avg(CASE WHEN ptp > 45 OR (peers >= 4 AND spread > 1e-6 AND l - m > 1.5 * spread) THEN 1.0 ELSE 0.0 END)')} AS bad_window_fraction FROM s GROUP BY ALL""")
def _(spark, d):
    return windowing.bad_window_fraction(windowing.window_table(sig(spark, d), 10), 45.0, 1.5)


@register("clipping_fraction", f"""WITH {SIG}, e AS (SELECT *, min(value) OVER k AS lo, max(value) OVER k AS hi, count(*) OVER k AS n FROM sig WINDOW k AS (PARTITION BY recording, channel)),
a AS (SELECT *, CASE WHEN value = lo OR value = hi THEN 1 ELSE 0 END AS edge FROM e), g AS (SELECT *, sample - row_number() OVER (PARTITION BY recording, channel, edge ORDER BY sample) AS island FROM a),
r AS (SELECT recording, channel, edge, n, lo, hi, island, count(*) AS len FROM g GROUP BY ALL)
SELECT recording, channel, {r6("CASE WHEN any_value(lo) = any_value(hi) THEN 1.0 ELSE sum(CASE WHEN edge = 1 AND len >= 2 THEN len ELSE 0 END) / CAST(any_value(n) AS DOUBLE) END")} AS clipping_fraction FROM r GROUP BY recording, channel""")
def _(spark, d):
    return windowing.clipping_fraction(sig(spark, d), 2)


@register("merge_intervals", f"""WITH {ANN}, s AS (SELECT recording, description, onset AS start, onset + duration AS "end" FROM ann),
m AS (SELECT *, CASE WHEN start <= max("end") OVER (PARTITION BY recording, description ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 3600.0 THEN 0 ELSE 1 END AS fresh FROM s),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY recording, description ORDER BY start, "end") AS island FROM m)
SELECT recording, description, {r6('min(start)')} AS start, {r6('max("end")')} AS "end", count(*) AS parts FROM i GROUP BY recording, description, island""")
def _(spark, d):
    spans = ann(spark, d).select("recording", "description", F.col("onset").alias("start"), (F.col("onset") + F.col("duration")).alias("end"))
    return windowing.merge_intervals(spans, ["recording", "description"], 3600.0)


@register("amplitude_intervals", f"""WITH {SIG}, h AS (SELECT recording, channel, k AS win, max(value) - min(value) AS ptp FROM sig, (SELECT unnest(range(100000)) AS k) WHERE channel = 'qty' AND k BETWEEN greatest(0, floor((sample - 10) / 5.0) + 1) AND floor(sample / 5.0) GROUP BY ALL HAVING count(*) = 10),
f AS (SELECT recording, CASE WHEN ptp > 47 THEN 'BAD_amplitude' WHEN ptp < 30 THEN 'BAD_flat' END AS description, win * 5 AS start, win * 5 + 10 AS "end" FROM h WHERE ptp > 47 OR ptp < 30),
m AS (SELECT *, CASE WHEN start <= max("end") OVER (PARTITION BY recording, description ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM f),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY recording, description ORDER BY start) AS island FROM m)
SELECT recording, description, CAST(min(start) AS BIGINT) AS start, CAST(max("end") AS BIGINT) AS "end", count(*) AS parts FROM i GROUP BY recording, description, island""")
def _(spark, d):
    return windowing.amplitude_intervals(signals.pick(sig(spark, d), ["qty"]), 10, 5, 47.0, 30.0)


@register("stim_events", f"""WITH {SIG}, c AS (SELECT recording, channel, sample, CAST(round_even(value * 100, 0) AS BIGINT) // 5 AS code FROM sig WHERE channel = 'disc'),
z AS (SELECT recording, max(CASE WHEN code = 0 THEN 1 ELSE 0 END) AS zero FROM c GROUP BY ALL), cnt AS (SELECT recording, code, count(*) AS n FROM c GROUP BY ALL), rest AS (SELECT recording, code AS rest FROM cnt QUALIFY row_number() OVER (PARTITION BY recording ORDER BY n DESC, code) = 1),
l AS (SELECT recording, channel, sample, CASE WHEN zero = 0 AND code = rest THEN 0 ELSE code END AS code FROM c JOIN z USING (recording) JOIN rest USING (recording)),
g AS (SELECT *, sample - row_number() OVER (PARTITION BY recording, code ORDER BY sample) AS island FROM l), r AS (SELECT recording, channel, code, island, min(sample) AS sample, count(*) AS len FROM g GROUP BY ALL),
p AS (SELECT *, coalesce(lag(code) OVER (PARTITION BY recording ORDER BY sample), 0) AS previous FROM r)
SELECT recording, channel, CAST(sample AS BIGINT) AS sample, CAST(previous AS BIGINT) AS previous, CAST(code AS BIGINT) AS code FROM p WHERE code <> 0 AND len >= 2""")
def _(spark, d):
    coded = signals.pick(sig(spark, d), ["disc"]).withColumn("value", F.expr("cast(rint(value * 100) as bigint) div 5").cast("double"))
    return windowing.stim_events(coded, 2)


# Features

@register("time_features", f"""WITH {SIG}, m AS (SELECT *, avg(value) OVER (PARTITION BY recording, channel) AS mu, value - lag(value) OVER o AS d FROM sig WINDOW o AS (PARTITION BY recording, channel ORDER BY sample)),
s AS (SELECT *, d - lag(d) OVER o AS d2, CASE WHEN value - mu < 0 THEN 1 ELSE 0 END AS below FROM m WINDOW o AS (PARTITION BY recording, channel ORDER BY sample)), x AS (SELECT *, CASE WHEN below <> lag(below) OVER (PARTITION BY recording, channel ORDER BY sample) THEN 1 ELSE 0 END AS crossed FROM s),
a AS (SELECT recording, channel, avg(abs(d)) AS ll, sum(crossed) AS z, {_N} AS n, var_pop(value) AS v0, var_pop(d) AS v1, var_pop(d2) AS v2, sqrt(avg(value * value)) AS rms, max(value) - min(value) AS ptp FROM x GROUP BY ALL)
SELECT recording, channel, {r6('ll')} AS line_length, {r6('z * 100.0 / n')} AS zero_crossing_rate, {r6('v0')} AS activity, {r6('CASE WHEN v0 > 0 THEN sqrt(v1 / v0) END')} AS mobility, {r6('CASE WHEN v0 > 0 AND v1 > 0 THEN sqrt(v2 / v1) / sqrt(v1 / v0) END')} AS complexity, {r6('rms')} AS rms, {r6('ptp')} AS ptp FROM a""")
def _(spark, d):
    return features.time_features(sig(spark, d), RATE)


@register("permutation_entropy", f"""WITH {SIG}, x AS (SELECT recording, channel, value AS a, lead(value, 1) OVER o AS b, lead(value, 2) OVER o AS c FROM sig WINDOW o AS (PARTITION BY recording, channel ORDER BY sample)),
p AS (SELECT recording, channel, CASE WHEN a <= b AND b <= c THEN 1 WHEN a <= c AND c < b THEN 2 WHEN b < a AND a <= c THEN 3 WHEN b <= c AND c < a THEN 4 WHEN c < a AND a <= b THEN 5 ELSE 6 END AS pat FROM x WHERE c IS NOT NULL),
n AS (SELECT recording, channel, pat, {_N} AS n FROM p GROUP BY ALL), q AS (SELECT *, n / sum(n) OVER (PARTITION BY recording, channel) AS s FROM n)
SELECT recording, channel, {r6('-sum(s * log2(s)) / log2(6)')} AS permutation_entropy FROM q GROUP BY ALL""")
def _(spark, d):
    return features.permutation_entropy(sig(spark, d))


@register("katz_fd", f"""WITH {SIG}, s AS (SELECT recording, channel, abs(value - lag(value) OVER o) AS d, abs(value - first_value(value) OVER o) AS away FROM sig WINDOW o AS (PARTITION BY recording, channel ORDER BY sample)),
a AS (SELECT recording, channel, sum(d) AS l, avg(d) AS m, max(away) AS r FROM s GROUP BY ALL)
SELECT recording, channel, {r6('CASE WHEN l > 0 AND r > 0 THEN log10(l / m) / (log10(l / m) + log10(r / l)) END')} AS katz_fd FROM a""")
def _(spark, d):
    return features.katz_fd(sig(spark, d))


@register("higuchi_fd", f"""WITH {EP}, k AS (SELECT unnest(range(1, 11)) AS k), s AS (SELECT a.recording, a.channel, k.k, a.sample % k.k AS m, count(*) + 1 AS c, sum(abs(a.value - b.value)) AS d FROM ep a JOIN k ON true JOIN ep b ON b.recording = a.recording AND b.sample = a.sample - k.k GROUP BY ALL),
l AS (SELECT recording, channel, k, avg(d * 63.0 / ((c - 1) * k) / k) AS len FROM s GROUP BY ALL)
SELECT recording, channel, {r6('regr_slope(ln(len), ln(1.0 / k))')} AS higuchi_fd FROM l WHERE len > 0 GROUP BY ALL""")
def _(spark, d):
    return features.higuchi_fd(ep(spark, d).drop("condition"))


@register("sample_entropy", f"""WITH {EP}, sd AS (SELECT recording, 0.2 * stddev_pop(value) AS tol FROM ep GROUP BY ALL), t AS (SELECT recording, sample, value AS a, lead(value, 1) OVER o AS b, lead(value, 2) OVER o AS c FROM ep WINDOW o AS (PARTITION BY recording ORDER BY sample)),
p AS (SELECT x.recording, CASE WHEN abs(x.c - y.c) <= tol THEN 1 ELSE 0 END AS longer FROM t x JOIN t y ON x.recording = y.recording AND x.sample < y.sample JOIN sd ON sd.recording = x.recording WHERE x.c IS NOT NULL AND y.c IS NOT NULL AND abs(x.a - y.a) <= tol AND abs(x.b - y.b) <= tol),
n AS (SELECT recording, sum(longer) AS l, count(*) AS s FROM p GROUP BY ALL)
SELECT sd.recording, 'e' AS channel, {r6("CASE WHEN s IS NULL THEN NULL WHEN l = 0 THEN CAST('inf' AS DOUBLE) ELSE -ln(l / CAST(s AS DOUBLE)) END")} AS sample_entropy FROM sd LEFT JOIN n ON n.recording = sd.recording""")
def _(spark, d):
    return features.sample_entropy(ep(spark, d))


# Annotations, events and epochs

@register("annotation_counts", f"WITH {ANN} SELECT recording, description, count(*) AS n, {r6('sum(duration)')} AS seconds FROM ann GROUP BY ALL")
def _(spark, d):
    return annotations.counts(ann(spark, d))


@register("annotation_crop", f"""WITH {ANN} SELECT recording, description, {r6('greatest(onset, 86400.0) - 86400.0')} AS onset, {r6('least(onset + duration, 864000.0) - greatest(onset, 86400.0)')} AS duration FROM ann WHERE onset + duration >= 86400.0 AND onset <= 864000.0""")
def _(spark, d):
    return annotations.crop(ann(spark, d), 86400.0, 864000.0).select("recording", "description", "onset", "duration")


@register("drop_bad_annotations", f"WITH {ANN}, b AS (SELECT recording, onset, CASE WHEN description = 'click' THEN ' BAD ' || description ELSE description END AS description FROM ann) SELECT recording, description, count(*) AS n FROM b WHERE NOT regexp_matches(trim(lower(description)), '^(bad|edge|boundary)') GROUP BY ALL")
def _(spark, d):
    marked = ann(spark, d).withColumn("description", F.when(F.col("description") == "click", F.concat(F.lit(" BAD "), "description")).otherwise(F.col("description")))
    return annotations.drop_bad(marked).groupBy("recording", "description").agg(F.count("*").alias("n"))


@register("event_codes", """WITH d AS (SELECT DISTINCT p_type || ' ' || p_size AS description FROM part), n AS (SELECT description, TRY_CAST(regexp_extract(description, '([0-9]{1,9})\\s*$', 1) AS INTEGER) AS own FROM d),
t AS (SELECT *, row_number() OVER (PARTITION BY own ORDER BY description) AS turn FROM n), f AS (SELECT description, own AS code FROM t WHERE own > 0 AND turn = 1),
r AS (SELECT description, row_number() OVER (ORDER BY description) AS place FROM t WHERE own IS NULL OR turn > 1),
free AS (SELECT k, row_number() OVER (ORDER BY k) AS place FROM (SELECT unnest(range(1, 1000000)) AS k) WHERE k NOT IN (SELECT code FROM f))
SELECT description, CAST(code AS BIGINT) AS code FROM f UNION ALL SELECT description, CAST(k AS BIGINT) AS code FROM r JOIN free USING (place)""")
def _(spark, d):
    return annotations.event_codes(_read(spark, d, "part").select(F.concat_ws(" ", "p_type", F.col("p_size").cast("string")).alias("description")))


@register("annotation_events", f"""WITH {ANN}, d AS (SELECT DISTINCT description FROM ann), c AS (SELECT description, row_number() OVER (ORDER BY description) AS code FROM d)
SELECT recording, CAST(round_even(onset * 10.0, 0) AS BIGINT) AS sample, CAST(0 AS BIGINT) AS previous, code, description FROM ann JOIN c USING (description)""")
def _(spark, d):
    a = ann(spark, d)
    return annotations.to_events(a, annotations.event_codes(a), 10.0)


_BAD = f"""{ANN}, sp AS (SELECT recording, greatest(CAST(floor(onset * 0.01) AS BIGINT), 0) AS start, greatest(CAST(ceil((onset + duration) * 0.01) AS BIGINT), CAST(floor(onset * 0.01) AS BIGINT) + 1) AS "end" FROM ann WHERE description = 'error'),
fm AS (SELECT *, CASE WHEN start <= max("end") OVER (PARTITION BY recording ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM sp),
im AS (SELECT *, sum(fresh) OVER (PARTITION BY recording ORDER BY start, "end") AS island FROM fm), bad AS (SELECT recording, min(start) AS start, max("end") AS "end" FROM im GROUP BY recording, island)"""


def _spans(spark, d):
    marked = ann(spark, d).withColumn("description", F.when(F.col("description") == "error", F.lit("BAD error")).otherwise(F.col("description")))
    return annotations.bad_spans(marked, 0.01)


def _lengths(spark, d):
    return ann(spark, d).groupBy("recording").agg((F.floor(F.max("onset") * 0.01) + 1).cast("long").alias("n_samples"))


@register("bad_time_fraction", f"""WITH {_BAD}, n AS (SELECT recording, CAST(floor(max(onset) * 0.01) AS BIGINT) + 1 AS n FROM ann GROUP BY ALL),
h AS (SELECT recording, sum(greatest(least("end", n) - start, 0)) AS b FROM bad JOIN n USING (recording) GROUP BY ALL)
SELECT recording, {r6('coalesce(b, 0) / CAST(n AS DOUBLE)')} AS bad_time_fraction FROM n LEFT JOIN h USING (recording)""")
def _(spark, d):
    return annotations.bad_time_fraction(_lengths(spark, d), _spans(spark, d))


@register("fixed_length_events", f"WITH {SIG}, n AS (SELECT recording, count(*) AS n FROM sig WHERE channel = 'qty' GROUP BY ALL), k AS (SELECT unnest(range(100000)) AS k) SELECT recording, CAST(round_even(k * 0.25 * 100.0, 0) AS BIGINT) AS sample, CAST(1 AS BIGINT) AS code FROM n, k WHERE k <= floor((n / 100.0 - 0.5 + 1e-9) / 0.25)")
def _(spark, d):
    lengths = sig(spark, d).where("channel = 'qty'").groupBy("recording").agg(F.count("*").alias("n_samples"))
    return epochs.fixed_length_events(lengths, RATE, 0.5, 0.25)


_EVENTS = f"""{SIG}, n AS (SELECT recording, count(*) AS n FROM wide GROUP BY ALL), ev AS (SELECT recording, sample, CAST(qty AS BIGINT) AS code FROM wide WHERE qty >= 46),
bad AS (SELECT recording, sample AS start, sample + 1 AS "end" FROM wide WHERE tax = 0.08 AND qty >= 40), pl AS (SELECT recording, sample, code, row_number() OVER (PARTITION BY recording ORDER BY sample, code) - 1 AS epoch, sample - 10 AS start, sample + 21 AS "end", n FROM ev JOIN n USING (recording)),
placed AS (SELECT *, CASE WHEN start < 0 OR "end" > n THEN 'OUT_OF_BOUNDS' WHEN EXISTS (SELECT 1 FROM bad WHERE bad.recording = pl.recording AND bad.start < pl."end" AND bad."end" > pl.start) THEN 'BAD_ANNOTATION' END AS dropped FROM pl),
cut AS (SELECT p.recording, p.epoch, p.code AS condition, s.channel, s.sample - p.sample AS time, s.value FROM placed p JOIN sig s ON s.recording = p.recording AND s.sample >= p.start AND s.sample < p."end" WHERE dropped IS NULL)"""


def _placed(spark, d):
    s = sig(spark, d)
    wide = signals.spread(s, CHANNELS)
    events = wide.where("qty >= 46").select("recording", "sample", F.col("qty").cast("long").alias("code"))
    bad = wide.where("tax = 0.08 and qty >= 40").select("recording", F.col("sample").alias("start"), (F.col("sample") + 1).alias("end"))
    lengths = wide.groupBy("recording").agg(F.count("*").alias("n_samples"))
    return s, epochs.place(events, lengths, -0.1, 0.2, RATE, bad, 64)


@register("epoch_drop_log", f"WITH {_EVENTS} SELECT recording, CAST(epoch AS BIGINT) AS epoch, CAST(sample AS BIGINT) AS sample, code, coalesce(dropped, 'KEPT') AS dropped FROM placed")
def _(spark, d):
    return _placed(spark, d)[1].select("recording", "epoch", "sample", "code", F.coalesce("dropped", F.lit("KEPT")).alias("dropped"))


_BASED = f"{_EVENTS}, based AS (SELECT recording, epoch, condition, channel, time, value - avg(CASE WHEN time BETWEEN -10 AND 0 THEN value END) OVER (PARTITION BY recording, epoch, channel) AS value FROM cut)"


def _epochs(spark, d):
    return epochs.baseline(epochs.cut(*_placed(spark, d), 64), -10, 0)


@register("evoked", f"WITH {_BASED} SELECT condition, channel, CAST(time AS BIGINT) AS time, {r6('avg(value)')} AS value, count(*) AS n FROM based GROUP BY ALL")
def _(spark, d):
    return epochs.average(_epochs(spark, d), ("condition",))


@register("epoch_rejection", f"""WITH {_BASED}, p AS (SELECT recording, epoch, channel, max(value) - min(value) AS ptp FROM based WHERE channel IN ('qty', 'tax') GROUP BY ALL), m AS (SELECT *, CASE WHEN ptp > 48 THEN 'REJECT' WHEN ptp < 0.079 THEN 'FLAT' END AS reason FROM p),
w AS (SELECT recording, epoch, max(reason) AS reason FROM m WHERE reason IS NOT NULL GROUP BY ALL)
SELECT w.recording, CAST(w.epoch AS BIGINT) AS epoch, w.reason, string_agg(m.channel, ',' ORDER BY m.channel) AS channels FROM w JOIN m ON m.recording = w.recording AND m.epoch = w.epoch AND m.reason = w.reason GROUP BY ALL""")
def _(spark, d):
    return epochs.rejected(signals.pick(_epochs(spark, d), ["qty", "tax"]), 48.0, 0.079)


@register("gfp", f"WITH {_BASED}, a AS (SELECT recording, condition, channel, time, avg(value) AS value FROM based GROUP BY ALL) SELECT recording, condition, CAST(time AS BIGINT) AS time, {r6('stddev_pop(value)')} AS gfp FROM a GROUP BY ALL")
def _(spark, d):
    return epochs.gfp(epochs.average(_epochs(spark, d)))


@register("evoked_peak", f"WITH {_BASED}, a AS (SELECT condition, channel, time, avg(value) AS value FROM based WHERE channel <> 'price' GROUP BY ALL) SELECT condition, channel, CAST(time AS BIGINT) AS time, {r6('value')} AS value FROM a WHERE time BETWEEN 1 AND 20 QUALIFY row_number() OVER (PARTITION BY condition ORDER BY abs(value) DESC, channel, time) = 1")
def _(spark, d):
    return epochs.peak(epochs.average(signals.drop_channels(_epochs(spark, d), ["price"]), ("condition",)), 1, 20, "abs", ("condition",))


@register("epoch_detrend", f"""WITH {_EVENTS}, l AS (SELECT recording, epoch, channel, regr_slope(value, CAST(time AS DOUBLE)) AS s, regr_intercept(value, CAST(time AS DOUBLE)) AS i FROM cut WHERE channel = 'qty' GROUP BY ALL)
SELECT recording, CAST(epoch AS BIGINT) AS epoch, {r6('sqrt(avg((value - s * time - i) ** 2))')} AS residual FROM cut JOIN l USING (recording, epoch, channel) GROUP BY ALL""")
def _(spark, d):
    flat = epochs.detrend(signals.pick(epochs.cut(*_placed(spark, d), 64), ["qty"]))
    return flat.groupBy("recording", "epoch").agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("residual"))


@register("samples_without_bad", f"""WITH {_EVENTS} SELECT recording, channel, count(*) AS n, {r6('avg(value)')} AS mean FROM sig WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.recording = sig.recording AND sig.sample >= bad.start AND sig.sample < bad."end") GROUP BY ALL""")
def _(spark, d):
    s = sig(spark, d)
    bad = signals.spread(s, CHANNELS).where("tax = 0.08 and qty >= 40").select("recording", F.col("sample").alias("start"), (F.col("sample") + 1).alias("end"))
    return annotations.without_bad(s, bad, 64).groupBy(*signals.KEY).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


# Spectra

_DFT = f"""{EP}, seg AS (SELECT recording, k AS segment, sample - k * 16 AS t, value FROM ep, (SELECT unnest(range(3)) AS k) WHERE sample >= k * 16 AND sample < k * 16 + 32),
cen AS (SELECT recording, segment, t, (value - avg(value) OVER (PARTITION BY recording, segment)) * (0.5 - 0.5 * cos(2 * pi() * t / 32)) AS v FROM seg), b AS (SELECT unnest(range(17)) AS bin),
ft AS (SELECT recording, segment, bin, sum(v * cos(2 * pi() * bin * t / 32)) AS re, sum(v * sin(2 * pi() * bin * t / 32)) AS im FROM cen, b GROUP BY ALL),
sp AS (SELECT recording, segment, bin, (re * re + im * im) / (64.0 * 12.0) * CASE WHEN bin IN (0, 16) THEN 1 ELSE 2 END AS p FROM ft),
psd AS (SELECT recording, 'e' AS channel, bin * 2.0 AS freq, avg(p) AS power FROM sp GROUP BY recording, bin)"""


def _psd(spark, d, average: str = "mean"):
    return spectral.welch(ep(spark, d).drop("condition"), 64.0, 0.5, 0.5, average)


@register("welch_psd", f"WITH {_DFT} SELECT recording, channel, freq, {r6('power')} AS power FROM psd")
def _(spark, d):
    return _psd(spark, d)


@register("welch_psd_median", f"WITH {_DFT} SELECT recording, 'e' AS channel, bin * 2.0 AS freq, {r6('median(p) / (1 + 1 / 3.0 - 1 / 2.0)')} AS power FROM sp GROUP BY recording, bin")
def _(spark, d):
    return _psd(spark, d, "median")


@register("band_power", f"""WITH {_DFT}, st AS (SELECT *, lead(freq) OVER o AS f2, lead(power) OVER o AS p2 FROM psd WINDOW o AS (PARTITION BY recording ORDER BY freq)), bd AS (SELECT * FROM (VALUES ('theta', 4.0, 8.0), ('alpha', 8.0, 14.0), ('beta', 14.0, 30.0)) v(band, lo, hi)),
a AS (SELECT recording, band, sum((f2 - freq) * (power + p2) / 2) AS power FROM st JOIN bd ON freq >= lo AND f2 <= hi GROUP BY ALL), tot AS (SELECT recording, sum((f2 - freq) * (power + p2) / 2) AS total FROM st WHERE freq >= 4 AND f2 <= 30 GROUP BY ALL)
SELECT recording, 'e' AS channel, band, {r6('power')} AS power, {r6('power / total')} AS relative FROM a JOIN tot USING (recording)""")
def _(spark, d):
    return spectral.band_power(_psd(spark, d), {"theta": (4.0, 8.0), "alpha": (8.0, 14.0), "beta": (14.0, 30.0)})


@register("dominant_band", f"""WITH {_DFT}, st AS (SELECT *, lead(freq) OVER o AS f2, lead(power) OVER o AS p2 FROM psd WINDOW o AS (PARTITION BY recording ORDER BY freq)), bd AS (SELECT * FROM (VALUES ('theta', 4.0, 8.0), ('alpha', 8.0, 14.0), ('beta', 14.0, 30.0)) v(band, lo, hi)),
a AS (SELECT recording, band, sum((f2 - freq) * (power + p2) / 2) AS power FROM st JOIN bd ON freq >= lo AND f2 <= hi GROUP BY ALL), r AS (SELECT recording, band, power / sum(power) OVER (PARTITION BY recording) AS relative FROM a)
SELECT recording, 'e' AS channel, band, {r6('relative')} AS relative FROM r QUALIFY row_number() OVER (PARTITION BY recording ORDER BY relative DESC, band DESC) = 1""")
def _(spark, d):
    return spectral.dominant_bands(_psd(spark, d), {"theta": (4.0, 8.0), "alpha": (8.0, 14.0), "beta": (14.0, 30.0)})


@register("spectral_edge", f"""WITH {_DFT}, c AS (SELECT recording, freq, sum(power) OVER (PARTITION BY recording ORDER BY freq) AS run, sum(power) OVER (PARTITION BY recording) AS total FROM psd WHERE freq <= 30)
SELECT recording, 'e' AS channel, min(freq) AS spectral_edge FROM c WHERE run >= 0.9 * total GROUP BY ALL""")
def _(spark, d):
    return spectral.spectral_edge(_psd(spark, d), 0.9, 30.0)


@register("spectral_entropy", f"""WITH {_DFT}, q AS (SELECT recording, power / sum(power) OVER (PARTITION BY recording) AS p FROM psd WHERE freq BETWEEN 1 AND 30) SELECT recording, 'e' AS channel, {r6('-sum(p * log2(p)) / log2(count(*))')} AS spectral_entropy FROM q GROUP BY ALL""")
def _(spark, d):
    return spectral.spectral_entropy(_psd(spark, d), 1.0, 30.0)


@register("peak_frequency", f"""WITH {_DFT}, best AS (SELECT *, row_number() OVER (PARTITION BY recording ORDER BY power DESC, freq) AS r FROM psd WHERE freq BETWEEN 7 AND 14)
SELECT recording, 'e' AS channel, max(CASE WHEN r = 1 THEN freq END) AS peak_frequency, {r6('sum(freq * power) / sum(power)')} AS centroid FROM best GROUP BY ALL""")
def _(spark, d):
    return spectral.peak_frequency(_psd(spark, d))


@register("aperiodic_fit", f"""WITH {_DFT}, l AS (SELECT recording, log10(freq) AS x, log10(power) AS y FROM psd WHERE freq BETWEEN 2 AND 30), f AS (SELECT recording, regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM l GROUP BY ALL),
r AS (SELECT l.recording, x, y, y - s * x - i AS r FROM l JOIN f ON f.recording = l.recording), q AS (SELECT *, quantile_cont(r, 0.75) OVER (PARTITION BY recording) AS q FROM r)
SELECT recording, 'e' AS channel, {r6('-regr_slope(y, x)')} AS exponent, {r6('regr_intercept(y, x)')} AS "offset" FROM q WHERE r < q + 0.05 GROUP BY ALL""")
def _(spark, d):
    return spectral.aperiodic(_psd(spark, d), 2.0, 30.0)


@register("spectrum_snr", f"""WITH {_DFT} SELECT recording, 'e' AS channel, {r6('10 * log10(avg(CASE WHEN freq BETWEEN 1 AND 12 THEN power END) / avg(CASE WHEN freq BETWEEN 16 AND 31 AND abs(freq - 20 * round_even(freq / 20, 0)) > 2 THEN power END))')} AS snr_db FROM psd GROUP BY ALL""")
def _(spark, d):
    return spectral.snr_db(_psd(spark, d), 20.0, (1.0, 12.0), (16.0, 31.0))


@register("line_noise", f"""WITH {_DFT} SELECT recording, 'e' AS channel, {r6('10 * log10(max(CASE WHEN abs(freq - 20) <= 1 THEN power END) / median(CASE WHEN abs(freq - 20) BETWEEN 3 AND 8 THEN power END))')} AS line_noise_db FROM psd GROUP BY ALL""")
def _(spark, d):
    return spectral.line_noise_db(_psd(spark, d), 20.0)


@register("spectrogram", f"WITH {_DFT} SELECT recording, 'e' AS channel, CAST(segment AS BIGINT) AS segment, {r6('(segment * 16 + 16) / 64.0')} AS time, bin * 2.0 AS freq, {r6('p')} AS power FROM sp")
def _(spark, d):
    return spectral.spectrogram(ep(spark, d).drop("condition"), 64.0, 0.5, 0.25)


@register("multitaper_psd")
def _(spark, d):
    cut = signals.segments(ep(spark, d).drop("condition"), 64, 64)
    return spectral.averaged(spectral.multitapers(cut, 64, 64.0), 64, 64.0)


@register("morlet_power")
def _(spark, d):
    cut = signals.segments(ep(spark, d).drop("condition"), 64, 64)
    return spectral.morlet_power(cut, 64, 64.0, [6.0, 10.0, 20.0], 5.0).select(*signals.KEY, "segment", F.posexplode("power").alias("place", "power"))


# Spatial operators

@register("average_reference", f"WITH {SIG}, r AS (SELECT recording, channel, sample, value - avg(CASE WHEN channel <> 'price' THEN value END) OVER (PARTITION BY recording, sample) AS value FROM sig) SELECT recording, channel, {r6('avg(value)')} AS mean, {r6('stddev_pop(value)')} AS std FROM r GROUP BY ALL")
def _(spark, d):
    made = spatial.set_reference(sig(spark, d), "average", ["price"])
    return made.groupBy(*signals.KEY).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


@register("median_reference", f"WITH {CAP} SELECT recording, channel, CAST(sample AS BIGINT) AS sample, {r6('value - median(value) OVER (PARTITION BY recording, sample)')} AS value FROM cap")
def _(spark, d):
    return spatial.set_reference(cap(spark, d), "median")


@register("bipolar_reference", f"WITH {SIG} SELECT recording, 'qty-tax' AS channel, CAST(sample AS BIGINT) AS sample, {r6('qty - tax')} AS value FROM wide UNION ALL SELECT recording, 'price-disc' AS channel, CAST(sample AS BIGINT) AS sample, {r6('price - disc')} AS value FROM wide")
def _(spark, d):
    return spatial.bipolar(sig(spark, d), [("qty", "tax"), ("price", "disc"), ("qty", "absent")])


def _cap_positions() -> dict[str, tuple[float, float, float]]:
    """The first 64 names of the 10-10 layout, in order, for the channels of ``cap``."""
    found = list(montage.standard_positions().values())[:64]
    return {f"c{i:02d}": p for i, p in enumerate(found)}


def _positions(spark):
    return spark.createDataFrame([(n, *map(float, p)) for n, p in _cap_positions().items()], "channel string, x double, y double, z double")


_POS = "pos(channel, x, y, z) AS (VALUES " + ", ".join(f"('{n}', CAST({p[0]!r} AS DOUBLE), CAST({p[1]!r} AS DOUBLE), CAST({p[2]!r} AS DOUBLE))" for n, p in _cap_positions().items()) + ")"
_NEAR = f"{_POS}, near AS (SELECT a.channel, b.channel AS neighbour, acos(least(greatest(a.x * b.x + a.y * b.y + a.z * b.z, -1.0), 1.0)) AS angle FROM pos a JOIN pos b ON a.channel <> b.channel), nb AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY round(angle, 9), neighbour) AS place FROM near QUALIFY place <= 4)"


@register("channel_neighbours", f"WITH {_NEAR} SELECT channel, neighbour, {r6('angle')} AS angle, place FROM nb")
def _(spark, d):
    return spatial.neighbours(_positions(spark), 4)


@register("hjorth_laplacian", f"WITH {CAP}, {_NEAR} SELECT c.recording, c.channel, CAST(c.sample AS BIGINT) AS sample, {r6('any_value(c.value) - avg(o.value)')} AS value FROM cap c JOIN nb ON nb.channel = c.channel JOIN cap o ON o.recording = c.recording AND o.sample = c.sample AND o.channel = nb.neighbour GROUP BY c.recording, c.channel, c.sample")
def _(spark, d):
    return spatial.apply_weights(cap(spark, d), spatial.hjorth_weights(spatial.neighbours(_positions(spark), 4)))


def _interpolation() -> list[tuple[str, str, float]]:
    at = _cap_positions()
    good = {n: p for n, p in at.items() if n not in ("c05", "c40")}
    import numpy as np

    made = montage.spline_weights(np.array(list(good.values())), np.array([at["c05"], at["c40"]]))
    return [(o, g, float(w)) for o, row in zip(("c05", "c40"), made, strict=True) for g, w in zip(good, row, strict=True)]


@register("interpolate_bads", f"WITH {CAP}, w(output, channel, weight) AS (VALUES " + ", ".join(f"('{o}', '{g}', CAST({w!r} AS DOUBLE))" for o, g, w in _interpolation()) + f") SELECT recording, output AS channel, CAST(sample AS BIGINT) AS sample, {r6('sum(value * weight)')} AS value FROM cap JOIN w USING (channel) GROUP BY ALL")
def _(spark, d):
    at = _cap_positions()
    weights = spatial.interpolation_weights(spark, {n: p for n, p in at.items() if n not in ("c05", "c40")}, {n: at[n] for n in ("c05", "c40")})
    return signals.pick(spatial.apply_weights(cap(spark, d), weights), ["c05", "c40"])


def _density() -> list[tuple[str, str, float]]:
    import numpy as np

    at = _cap_positions()
    made = montage.density_weights(np.array(list(at.values())))
    return [(o, c, float(w)) for o, row in zip(at, made, strict=True) for c, w in zip(at, row, strict=True)]


@register("current_source_density", f"WITH {CAP}, w(output, channel, weight) AS (VALUES " + ", ".join(f"('{o}', '{c}', CAST({w!r} AS DOUBLE))" for o, c, w in _density()) + f") SELECT recording, output AS channel, CAST(sample AS BIGINT) AS sample, {r6('sum(value * weight)')} AS value FROM cap JOIN w USING (channel) GROUP BY ALL")
def _(spark, d):
    return spatial.apply_weights(cap(spark, d), spatial.density_weights(spark, _cap_positions()))


# Connectivity

_CORR = f"{CAP}, pr AS (SELECT a.recording, a.channel AS a, b.channel AS b, coalesce(corr(a.value, b.value), 0.0) AS value FROM cap a JOIN cap b ON a.recording = b.recording AND a.sample = b.sample AND a.channel < b.channel GROUP BY ALL), sd AS (SELECT recording, a AS channel, value FROM pr UNION ALL SELECT recording, b, value FROM pr)"


@register("correlation_matrix", f"WITH {_CORR} SELECT recording, a, b, {r6('value')} AS value FROM pr")
def _(spark, d):
    return connectivity.correlation(cap(spark, d))


@register("node_strength", f"WITH {_CORR} SELECT recording, channel, {r6('avg(abs(value))')} AS node_strength FROM sd GROUP BY ALL")
def _(spark, d):
    return connectivity.node_strength(connectivity.correlation(cap(spark, d)))


@register("strongest_connections", f"WITH {_CORR} SELECT recording, a, b, {r6('value')} AS value, row_number() OVER (PARTITION BY recording ORDER BY abs(value) DESC, a, b) AS place FROM pr QUALIFY place <= 5")
def _(spark, d):
    return connectivity.strongest(connectivity.correlation(cap(spark, d)), 5)


_WCORR = f"{CAP}, wc AS (SELECT a.recording, a.sample // 10 AS win, a.channel AS a, b.channel AS b, coalesce(corr(a.value, b.value), 0.0) AS value FROM cap a JOIN cap b ON a.recording = b.recording AND a.sample = b.sample AND a.channel < b.channel GROUP BY ALL HAVING count(*) = 10), ws AS (SELECT recording, win, a AS channel, b AS other, value FROM wc UNION ALL SELECT recording, win, b, a, value FROM wc)"


@register("max_correlation", f"WITH {_WCORR} SELECT recording, channel, CAST(win AS BIGINT) AS \"window\", {r6('max(abs(value))')} AS max_correlation FROM ws GROUP BY ALL")
def _(spark, d):
    return connectivity.max_correlation(connectivity.window_correlations(cap(spark, d), 10))


@register("neighbour_correlation", f"WITH {_WCORR}, {_NEAR}, m AS (SELECT recording, ws.channel, other, median(abs(value)) AS r FROM ws JOIN nb ON nb.channel = ws.channel AND nb.neighbour = ws.other GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY recording, channel ORDER BY r DESC, other) AS p FROM m) SELECT recording, channel, {r6('avg(r)')} AS neighbour_correlation FROM t WHERE p <= 2 GROUP BY ALL")
def _(spark, d):
    return connectivity.neighbour_correlation(connectivity.window_correlations(cap(spark, d), 10), spatial.neighbours(_positions(spark), 4))


_CROSS = f"""{SIG}, ns AS (SELECT recording, max(sample) + 1 AS n FROM wide GROUP BY ALL), seg AS (SELECT s.recording, channel, k AS segment, sample - k * 16 AS t, value FROM sig s JOIN ns USING (recording), (SELECT unnest(range(100000)) AS k) WHERE k BETWEEN greatest(0, floor((sample - 32) / 16.0) + 1) AND floor(sample / 16.0) AND k * 16 + 32 <= n),
cen AS (SELECT recording, channel, segment, t, (value - avg(value) OVER (PARTITION BY recording, channel, segment)) * (0.5 - 0.5 * cos(2 * pi() * t / 32)) AS v FROM seg), b AS (SELECT unnest(range(3, 10)) AS bin),
ft AS (SELECT recording, channel, segment, bin, sum(v * cos(2 * pi() * bin * t / 32)) AS re, -sum(v * sin(2 * pi() * bin * t / 32)) AS im FROM cen, b GROUP BY ALL),
cr AS (SELECT x.recording, x.channel AS a, y.channel AS b, x.bin, x.re * y.re + x.im * y.im AS re, x.im * y.re - x.re * y.im AS im, x.re * x.re + x.im * x.im AS aa, y.re * y.re + y.im * y.im AS bb FROM ft x JOIN ft y ON x.recording = y.recording AND x.segment = y.segment AND x.bin = y.bin AND x.channel < y.channel),
su AS (SELECT recording, a, b, bin, sum(re) AS re, sum(im) AS im, sum(aa) AS aa, sum(bb) AS bb, avg(sign(im)) AS sg, sum(abs(im)) AS sz FROM cr GROUP BY ALL)"""
for _name, _value in {"coherence": "CASE WHEN aa * bb > 0 THEN (re * re + im * im) / (aa * bb) ELSE 0.0 END", "imcoh": "CASE WHEN aa * bb > 0 THEN abs(im / sqrt(aa * bb)) ELSE 0.0 END", "pli": "abs(sg)", "wpli": "CASE WHEN sz > 0 THEN abs(im) / sz ELSE 0.0 END"}.items():
    register(f"connectivity_{_name}", f"WITH {_CROSS} SELECT recording, a, b, {r6(f'avg({_value})')} AS value FROM su GROUP BY ALL")(lambda spark, d, m=_name: connectivity.spectral(sig(spark, d), RATE, 9.0, 29.0, m, 0.32))


@register("phase_locking")
def _(spark, d):
    return connectivity.phase_locking(sig(spark, d), RATE, 8.0, 13.0)


@register("envelope_correlation")
def _(spark, d):
    return connectivity.envelope_correlation(sig(spark, d), RATE, 8.0, 13.0)


# Rankings

_TRIALS = f"{EP}, tr AS (SELECT 'f' || CAST(sample AS VARCHAR) AS channel, recording AS trial, condition, value FROM ep)"


def _trials(spark, d):
    return ep(spark, d).select(F.lit(0).cast("long").alias("recording"), F.concat(F.lit("f"), F.col("sample").cast("string")).alias("channel"), F.col("recording").alias("trial"), "condition", "value")


@register("fisher_score", f"""WITH {_TRIALS}, c AS (SELECT channel, condition, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM tr GROUP BY ALL), g AS (SELECT *, sum(n * m) OVER (PARTITION BY channel) / sum(n) OVER (PARTITION BY channel) AS mu FROM c),
s AS (SELECT channel, {r6('sum(n * (m - mu) * (m - mu)) / sum(n * v)')} AS fisher FROM g GROUP BY ALL) SELECT CAST(0 AS BIGINT) AS recording, channel, fisher, row_number() OVER (ORDER BY fisher DESC, channel) AS rank FROM s""")
def _(spark, d):
    return ranking.ranked(ranking.fisher(_trials(spark, d)).withColumn("fisher", F.round("fisher", 6)), "fisher")


@register("auc", f"""WITH {_TRIALS}, p AS (SELECT channel, condition, rank() OVER o + (count(*) OVER (PARTITION BY channel, value) - 1) / 2.0 AS place FROM tr WHERE condition IN ('0', '1') WINDOW o AS (PARTITION BY channel ORDER BY value)),
s AS (SELECT channel, sum(CASE WHEN condition = '0' THEN place END) AS r, sum(CASE WHEN condition = '0' THEN 1.0 ELSE 0.0 END) AS n1, sum(CASE WHEN condition = '1' THEN 1.0 ELSE 0.0 END) AS n2 FROM p GROUP BY ALL), u AS (SELECT channel, (r - n1 * (n1 + 1) / 2) / (n1 * n2) AS u FROM s)
SELECT CAST(0 AS BIGINT) AS recording, channel, {r6('CAST(greatest(u, 1 - u) AS DOUBLE)')} AS auc FROM u""")
def _(spark, d):
    return ranking.auc(_trials(spark, d), "0", "1")


@register("welch_t", f"""WITH {_TRIALS}, s AS (SELECT channel, avg(value) FILTER (condition = '0') AS m0, avg(value) FILTER (condition = '1') AS m1, var_samp(value) FILTER (condition = '0') / count(*) FILTER (condition = '0') AS a, var_samp(value) FILTER (condition = '1') / count(*) FILTER (condition = '1') AS b, count(*) FILTER (condition = '0') AS n0, count(*) FILTER (condition = '1') AS n1 FROM tr GROUP BY ALL)
SELECT CAST(0 AS BIGINT) AS recording, channel, {r6('(m0 - m1) / sqrt(a + b)')} AS t, {r6('(a + b) * (a + b) / (a * a / (n0 - 1) + b * b / (n1 - 1))')} AS df FROM s""")
def _(spark, d):
    return ranking.welch_t(_trials(spark, d), "0", "1")


@register("anova", f"""WITH {_TRIALS}, c AS (SELECT channel, condition, {_N} AS n, avg(value) AS m, var_pop(value) AS v FROM tr GROUP BY ALL), g AS (SELECT *, sum(n * m) OVER (PARTITION BY channel) / sum(n) OVER (PARTITION BY channel) AS mu FROM c),
s AS (SELECT channel, sum(n * (m - mu) * (m - mu)) AS b, sum(n * v) AS w, CAST(count(*) - 1 AS DOUBLE) AS df1, sum(n) - count(*) AS df2 FROM g GROUP BY ALL) SELECT CAST(0 AS BIGINT) AS recording, channel, {r6('b / df1 / (w / df2)')} AS f, df1, df2 FROM s""")
def _(spark, d):
    return ranking.anova(_trials(spark, d))


@register("trial_tests")
def _(spark, d):
    return ranking.with_p(ranking.welch_t(_trials(spark, d), "0", "1"))


@register("channel_features")
def _(spark, d):
    return features.channel_features(sig(spark, d), RATE)


@register("erd_ers", f"WITH {EP}, s AS (SELECT condition, sample, avg(value * value) AS p FROM ep GROUP BY ALL) SELECT CAST(condition AS BIGINT) AS recording, 'e' AS channel, {r6('100 * (avg(p) FILTER (sample BETWEEN 32 AND 63) / avg(p) FILTER (sample BETWEEN 0 AND 15) - 1)')} AS erd_percent FROM s GROUP BY ALL")
def _(spark, d):
    return ranking.erd_ers(_erp(spark, d), (32, 63), (0, 15))


def _erp(spark, d):
    return ep(spark, d).select(F.col("condition").cast("long").alias("recording"), "channel", F.col("recording").alias("trial"), F.col("sample").alias("time"), "condition", "value")


@register("erp_snr")
def _(spark, d):
    return ranking.erp_snr(_erp(spark, d))


@register("decoding_accuracy")
def _(spark, d):
    trials = _erp(spark, d).withColumn("recording", F.lit(0).cast("long"))
    return ranking.decoding_accuracy(ranking.bin_features(trials), repeats=2)


# Filters

_TAPS = [0.0625, 0.25, 0.375, 0.25, 0.0625]


@register("short_fir", f"WITH {SIG} SELECT recording, channel, CAST(sample AS BIGINT) AS sample, " + r6(" + ".join(f"coalesce({f'lag(value, {k - 2})' if k > 2 else f'lead(value, {2 - k})'} OVER o, 0.0) * {t}" for k, t in enumerate(_TAPS))) + " AS value FROM sig WINDOW o AS (PARTITION BY recording, channel ORDER BY sample)")
def _(spark, d):
    return filtering.weighted_frame(sig(spark, d), _TAPS)


@register("band_pass")
def _(spark, d):
    return filtering.band_filter(sig(spark, d), 1.0, 30.0, RATE)


@register("notch")
def _(spark, d):
    return filtering.notch_filter(sig(spark, d), 20.0, RATE)


@register("fir_band_pass")
def _(spark, d):
    return filtering.band_filter(sig(spark, d), 8.0, 13.0, RATE, "fir")


@register("resample")
def _(spark, d):
    return filtering.resample(sig(spark, d), RATE, 40.0)


@register("band_envelope")
def _(spark, d):
    return filtering.envelope(sig(spark, d), 8.0, 13.0, RATE)


# Quality, bad channels, components

@register("quality_quick", f"""WITH {SIG}, {_windows(10)}, fl AS (SELECT recording, channel, avg(CASE WHEN std < 0.5 THEN 1.0 ELSE 0.0 END) AS flat_fraction FROM w GROUP BY ALL), lw AS (SELECT *, log10(greatest(std, 1e-6)) AS l FROM w),
mw AS (SELECT *, median(l) OVER p AS m, count(*) OVER p AS peers FROM lw WINDOW p AS (PARTITION BY recording, win)), sw AS (SELECT *, 1.4826 * median(abs(l - m)) OVER (PARTITION BY recording, win) AS spread FROM mw),
bw AS (SELECT recording, channel, avg(CASE WHEN ptp > 200 OR (peers >= 4 AND spread > 1e-6 AND l - m > 5 * spread) THEN 1.0 ELSE 0.0 END) AS bad_window_fraction FROM sw GROUP BY ALL),
am AS (SELECT recording, channel, count(*) AS n, 0.7413 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) AS amplitude FROM sig GROUP BY ALL), la AS (SELECT *, log10(greatest(amplitude, 1e-6)) AS l FROM am), ma AS (SELECT *, median(l) OVER (PARTITION BY recording) AS m FROM la),
za AS (SELECT *, 1.4826 * median(abs(l - m)) OVER (PARTITION BY recording) AS mad, stddev_pop(l) OVER (PARTITION BY recording) AS sd FROM ma), t AS (SELECT recording, channel, n, amplitude, coalesce((l - m) / CASE WHEN mad > 1e-12 THEN mad WHEN sd > 1e-12 THEN sd END, 0.0) AS z, coalesce(flat_fraction, 0.0) AS f, coalesce(bad_window_fraction, 0.0) AS b FROM za LEFT JOIN fl USING (recording, channel) LEFT JOIN bw USING (recording, channel)),
pen AS (SELECT *, 100 * least(greatest(f / 0.5, 0), 1) AS p1, CASE WHEN f < 0.5 THEN 40 * least(greatest((abs(z) - 3) / 5, 0), 1) ELSE 0 END AS p2, CASE WHEN f < 0.5 THEN 30 * least(greatest((b - 0.02) / 0.28, 0), 1) ELSE 0 END AS p3 FROM t),
sc AS (SELECT *, CASE WHEN f < 0.5 THEN least(greatest(100 - p1 - p2 - p3, 0), 100) ELSE 0 END AS exact FROM pen)
SELECT recording, channel, n, {r6('amplitude')} AS amplitude, {r6('f')} AS flat_fraction, {r6('b')} AS bad_window_fraction, {r6('z')} AS deviation_z, round(CAST(exact AS DOUBLE), 1) AS score, CASE WHEN exact >= 75 THEN 'good' WHEN exact >= 50 THEN 'fair' WHEN exact >= 25 THEN 'poor' ELSE 'bad' END AS grade, row_number() OVER (PARTITION BY recording ORDER BY round(CAST(exact AS DOUBLE), 1) DESC, channel) AS rank FROM sc""")
def _(spark, d):
    return quality.quick(sig(spark, d), 10, 0.5, 200.0).select("recording", "channel", "n", "amplitude", "flat_fraction", "bad_window_fraction", "deviation_z", "score", "grade", "rank")


@register("channel_quality")
def _(spark, d):
    return quality.assess(sig(spark, d), RATE)


@register("bad_channels")
def _(spark, d):
    return bad_channels.find_bad_channels(sig(spark, d), RATE)


@register("ica_components")
def _(spark, d):
    return ica.fit(signals.drop_channels(sig(spark, d), ["price"]))


@register("ica_sources")
def _(spark, d):
    s = signals.drop_channels(sig(spark, d), ["price"])
    return ica.sources(s, kept(ica.fit(s))).groupBy(*signals.KEY).agg(F.count("*").alias("n"), F.stddev_pop("value").alias("std"))


# Names

_RAW_NAMES = ["EEG Fp1-REF", "EEG FP2-LE", "fz", "T3", "t6", "EEG Cz.", "O1..", "EKG1", "VEOG", "STI 014", "Status", "EMG chin", "EXG1", "EXG Channel 3", "SpO2", "Resp nasal", "odd name", "AFz-A1", "POZ", "A1"]


@register("channel_names", "WITH n(name, clean, kind) AS (VALUES ('EEG Fp1-REF', 'Fp1', 'eeg'), ('EEG FP2-LE', 'Fp2', 'eeg'), ('fz', 'Fz', 'eeg'), ('T3', 'T7', 'eeg'), ('t6', 'P8', 'eeg'), ('EEG Cz.', 'Cz', 'eeg'), ('O1..', 'O1', 'eeg'), ('EKG1', 'EKG1', 'ecg'), ('VEOG', 'VEOG', 'eog'), ('STI 014', 'STI 014', 'stim'), ('Status', 'Status', 'stim'), ('EMG chin', 'EMG chin', 'emg'), ('EXG1', 'EXG1', 'misc'), ('EXG Channel 3', 'EXG Channel 3', 'eeg'), ('SpO2', 'SpO2', 'misc'), ('Resp nasal', 'Resp nasal', 'resp'), ('odd name', 'odd name', 'eeg'), ('AFz-A1', 'AFz', 'eeg'), ('POZ', 'POz', 'eeg'), ('A1', 'A1', 'eeg')) SELECT name, clean, kind FROM n")
def _(spark, d):
    raw = spark.createDataFrame([(n,) for n in _RAW_NAMES], "name string")
    clean = names.clean_channel_name(F.col("name"))
    return raw.select("name", clean.alias("clean"), names.channel_type(clean).alias("kind"))


# Selection, unions and types

@register("crop", f"WITH {SIG} SELECT recording, channel, CAST(sample - 50 AS BIGINT) AS sample, {r6('value')} AS value FROM sig WHERE sample >= 50 AND sample < 200")
def _(spark, d):
    return signals.crop(sig(spark, d), 0.5, 2.0, RATE)


@register("append_recordings", f"WITH {SIG}, n AS (SELECT recording, max(sample) + 1 AS n FROM sig WHERE channel = 'qty' GROUP BY ALL) SELECT recording, channel, CAST(sample AS BIGINT) AS sample, {r6('value')} AS value FROM sig WHERE channel = 'qty' UNION ALL SELECT recording, channel, CAST(sample + n AS BIGINT) AS sample, {r6('value')} AS value FROM sig JOIN n USING (recording) WHERE channel = 'qty'")
def _(spark, d):
    one = signals.pick(sig(spark, d), ["qty"])
    return signals.append(one, one)[0]


@register("derived_channel", f"WITH {SIG} SELECT recording, 'net' AS channel, CAST(sample AS BIGINT) AS sample, {r6('price - 2 * tax')} AS value FROM wide")
def _(spark, d):
    return signals.pick(signals.add_channel(sig(spark, d), "net", {"price": 1.0, "tax": -2.0}), ["net"])


@register("rename_and_drop", f"WITH {SIG} SELECT recording, CASE channel WHEN 'qty' THEN 'Cz' ELSE channel END AS channel, count(*) AS n FROM sig WHERE channel <> 'tax' GROUP BY ALL")
def _(spark, d):
    return signals.rename_channels(signals.drop_channels(sig(spark, d), ["tax"]), {"qty": "Cz"}).groupBy(*signals.KEY).agg(F.count("*").alias("n"))


def _typed(spark, d):
    renamed = signals.rename_channels(sig(spark, d), {"qty": "EEG Cz-REF", "price": "VEOG", "disc": "STI 014", "tax": "Pz"})
    return channels.set_bads(channels.set_montage(channels.described(renamed)), ["Pz"])


@register("channel_types", f"WITH {SIG}, k AS (SELECT DISTINCT recording, channel FROM sig) SELECT recording, CASE channel WHEN 'price' THEN 'eog' WHEN 'disc' THEN 'stim' ELSE 'eeg' END AS ch_type, count(*) AS n FROM k GROUP BY ALL")
def _(spark, d):
    return channels.type_counts(_typed(spark, d))


@register("pick_channels", f"WITH {SIG}, k AS (SELECT DISTINCT recording FROM sig) SELECT recording, c AS channel FROM k, (VALUES ('EEG Cz-REF'), ('VEOG')) v(c)")
def _(spark, d):
    return channels.pick(_typed(spark, d), ["good", "eog", "pz"], exclude_bad=True).select("recording", "channel")


@register("annotation_select", f"WITH {ANN} SELECT recording, description, count(*) AS n FROM ann WHERE regexp_matches(description, 'c.*k') OR description = 'error' GROUP BY ALL")
def _(spark, d):
    a = ann(spark, d)
    both = annotations.select(a, regexp="c.*k").unionByName(annotations.select(a, ["error"]))
    return annotations.counts(both).drop("seconds")


# Event time

@register("sessions", """WITH e AS (SELECT user_id AS recording, event_type AS description, ts FROM events), m AS (SELECT *, CASE WHEN ts < lag(ts) OVER o + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM e WINDOW o AS (PARTITION BY recording, description ORDER BY ts)),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY recording, description ORDER BY ts ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT recording, description, epoch_us(min(ts)) AS start, epoch_us(max(ts)) + 21600000000 AS "end", count(*) AS n FROM i GROUP BY recording, description, island""")
def _(spark, d):
    rows = _read(spark, d, "events").select(F.col("user_id").alias("recording"), F.col("event_type").alias("description"), F.col("ts").cast("timestamp").alias("ts"))
    return causal.sessions(rows, "ts", "6 hours", "1 hour").select("recording", "description", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "n")


@register("event_windows", f"""WITH e AS (SELECT event_type AS channel, value, epoch_us(ts) // 86400000000 AS day FROM events) SELECT channel, CAST(day * 86400000000 AS BIGINT) AS start, count(*) AS n, {r6('avg(value)')} AS mean, {r6('stddev_pop(value)')} AS std, {r6('max(value) - min(value)')} AS ptp FROM e GROUP BY ALL""")
def _(spark, d):
    rows = _read(spark, d, "events").select(F.lit("all").alias("recording"), F.col("event_type").alias("channel"), "value", F.col("ts").cast("timestamp").alias("ts"))
    return causal.windowed_table(rows, "ts", "1 day", "1 hour").select("channel", F.unix_micros("start").alias("start"), "n", "mean", "std", "ptp")


# Artifacts

@register("mains")
def _(spark, d):
    return artifacts.mains(sig(spark, d), 120.0)


@register("muscle_bursts")
def _(spark, d):
    return artifacts.muscle(signals.drop_channels(sig(spark, d), ["price"]), RATE, threshold=2.0)


@register("blinks")
def _(spark, d):
    return artifacts.blinks(sig(spark, d), RATE, "qty")


@register("artifact_annotations")
def _(spark, d):
    return artifacts.annotate(signals.pick(sig(spark, d), ["qty", "price"]), RATE)


@register("resample_stim", f"""WITH {SIG}, c AS (SELECT recording, channel, sample, CAST(qty AS BIGINT) // 25 AS code FROM (SELECT *, 'qty' AS channel FROM wide)), g AS (SELECT *, sample - row_number() OVER (PARTITION BY recording, code ORDER BY sample) AS island FROM c),
r AS (SELECT recording, code, min(sample) AS start, count(*) AS len FROM g WHERE code <> 0 GROUP BY recording, code, island), p AS (SELECT recording, code, CAST(round_even(start * 0.5, 0) AS BIGINT) AS a, greatest(CAST(round_even((start + len) * 0.5, 0) AS BIGINT), CAST(round_even(start * 0.5, 0) AS BIGINT) + 1) AS b FROM r),
n AS (SELECT recording, CAST(ceil(count(*) * 0.5) AS BIGINT) AS n FROM wide GROUP BY ALL), t AS (SELECT recording, unnest(range(n)) AS sample FROM n)
SELECT t.recording, 'qty' AS channel, t.sample, CAST(coalesce(max(p.code), 0) AS DOUBLE) AS value FROM t LEFT JOIN p ON p.recording = t.recording AND t.sample >= p.a AND t.sample < p.b GROUP BY ALL""")
def _(spark, d):
    coded = signals.pick(sig(spark, d), ["qty"]).withColumn("value", F.expr("cast(value as bigint) div 25").cast("double"))
    return filtering.resample_stim(coded, RATE, RATE / 2)


# Trials

@register("trial_bins", f"WITH {EP} SELECT CAST(condition AS BIGINT) AS recording, 'e' AS channel, recording AS trial, condition, CAST(least(floor(sample * 5 / 64.0), 4) AS BIGINT) AS feature, {r6('avg(value)')} AS value FROM ep GROUP BY ALL")
def _(spark, d):
    return ranking.bin_features(_erp(spark, d))


@register("erds_timecourse", f"""WITH {EP}, s AS (SELECT condition, sample, avg(value * value) AS p FROM ep GROUP BY ALL), w AS (SELECT *, avg(CASE WHEN sample BETWEEN 0 AND 15 THEN p END) OVER (PARTITION BY condition) AS rest, avg(p) OVER (PARTITION BY condition ORDER BY sample ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING) AS near FROM s)
SELECT CAST(condition AS BIGINT) AS recording, 'e' AS channel, CAST(sample AS BIGINT) AS time, {r6('100 * (near - rest) / rest')} AS percent FROM w""")
def _(spark, d):
    return report.erds_timecourse(_erp(spark, d), 64.0, (0, 15))


@register("rank_by_band")
def _(spark, d):
    return ranking.rank_channels(sig(spark, d), RATE, "alpha")


@register("rank_by_discriminability", f"""WITH {_TRIALS}, c AS (SELECT channel, condition, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM tr WHERE condition IN ('0', '1') GROUP BY ALL), g AS (SELECT *, sum(n * m) OVER (PARTITION BY channel) / sum(n) OVER (PARTITION BY channel) AS mu FROM c),
s AS (SELECT channel, sum(n * (m - mu) * (m - mu)) / sum(n * v) AS value FROM g GROUP BY ALL), p AS (SELECT channel, condition, rank() OVER o + (count(*) OVER (PARTITION BY channel, value) - 1) / 2.0 AS place FROM tr WHERE condition IN ('0', '1') WINDOW o AS (PARTITION BY channel ORDER BY value)),
r AS (SELECT channel, sum(CASE WHEN condition = '0' THEN place END) AS r, sum(CASE WHEN condition = '0' THEN 1.0 ELSE 0.0 END) AS n1, sum(CASE WHEN condition = '1' THEN 1.0 ELSE 0.0 END) AS n2 FROM p GROUP BY ALL), u AS (SELECT channel, (r - n1 * (n1 + 1) / 2) / (n1 * n2) AS u FROM r),
m AS (SELECT channel, avg(CASE WHEN condition = '0' THEN value END) - avg(CASE WHEN condition = '1' THEN value END) AS gap, var_samp(CASE WHEN condition = '0' THEN value END) / count(CASE WHEN condition = '0' THEN 1 END) AS a, var_samp(CASE WHEN condition = '1' THEN value END) / count(CASE WHEN condition = '1' THEN 1 END) AS b, count(CASE WHEN condition = '0' THEN 1 END) AS na, count(CASE WHEN condition = '1' THEN 1 END) AS nb FROM tr WHERE condition IN ('0', '1') GROUP BY ALL),
t AS (SELECT channel, abs(gap) / sqrt(a + b) AS t, (a + b) * (a + b) / (a * a / (na - 1) + b * b / (nb - 1)) AS df FROM m),
i AS (SELECT channel, t, df, unnest(range(2001)) AS i FROM t), -- Simpson's rule over the density of Student's t
pv AS (SELECT channel, 1 - 2 * any_value(exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(pi() * df)) * any_value(t) / 6000 * sum((CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * power(1 + (t * i / 2000) * (t * i / 2000) / df, -(df + 1) / 2)) AS p FROM i GROUP BY ALL)
SELECT CAST(0 AS BIGINT) AS recording, channel, {r6('value')} AS value, row_number() OVER (ORDER BY value DESC, channel) AS rank, '0' AS feature, {r6('CAST(greatest(u, 1 - u) AS DOUBLE)')} AS auc, {r6('p')} AS p_value FROM s JOIN u USING (channel) JOIN pv USING (channel)""")
def _(spark, d):
    two = _trials(spark, d).where("condition in ('0', '1')").withColumn("time", F.lit(0).cast("long"))
    return ranking.rank_trials(two, "discriminability")


# Files, pipelines, reports

@register("edf_round_trip", f"WITH {SIG} SELECT CAST(recording AS VARCHAR) AS recording, channel, count(*) AS n, true AS close FROM sig GROUP BY ALL")
def _(spark, d):
    s = sig(spark, d)
    folder = shared_folder(spark, "edf")
    files.write(s, folder, RATE).write.format("noop").mode("overwrite").save()
    read = files.read(spark, folder).withColumnRenamed("value", "read")
    both = s.withColumn("recording", F.col("recording").cast("string")).join(read, [*signals.KEY, "sample"])
    span = F.greatest(F.max("value") - F.min("value"), F.lit(1.0))
    return both.groupBy(*signals.KEY).agg(F.count("*").alias("n"), (F.max(F.abs(F.col("value") - F.col("read"))) < span * 1e-4).alias("close"))


@register("matlab_round_trip", f"WITH {SIG} SELECT CAST(recording AS VARCHAR) AS recording, channel, count(*) AS n, true AS close FROM sig GROUP BY ALL")
def _(spark, d):
    s, folder = sig(spark, d), shared_folder(spark, "matlab")
    files.write(s, folder, RATE, "matlab").write.format("noop").mode("overwrite").save()
    read = files.read(spark, folder, range_mb=0.01).withColumnRenamed("value", "read")
    both = s.withColumn("recording", F.col("recording").cast("string")).join(read, [*signals.KEY, "sample"])
    return both.groupBy(*signals.KEY).agg(F.count("*").alias("n"), F.bool_and(F.col("value") == F.col("read")).alias("close"))


@register("edf_sample_range", f"WITH {SIG} SELECT CAST(recording AS VARCHAR) AS recording, channel, count(*) AS n, min(sample) AS first, max(sample) AS last FROM sig WHERE sample BETWEEN 200 AND 349 GROUP BY ALL")
def _(spark, d):
    """Ranges of records outside of the samples asked for aren't read."""
    folder = shared_folder(spark, "edf")
    files.write(sig(spark, d), folder, RATE).write.format("noop").mode("overwrite").save()
    part = files.read(spark, folder, range_mb=0.001).where("sample >= 200 and sample < 350")
    return part.groupBy(*signals.KEY).agg(F.count("*").alias("n"), F.min("sample").alias("first"), F.max("sample").alias("last"))


@register("recording_covariance", f"WITH {SIG} SELECT a.recording, a.channel AS a, b.channel AS b, count(*) AS n, {r6('covar_pop(a.value, b.value)')} AS covariance FROM sig a JOIN sig b USING (recording, sample) GROUP BY ALL")
def _(spark, d):
    """What independent components are fitted to, from sums over blocks of samples."""
    found = ica.moments(ica.in_blocks(sig(spark, d))).select("recording", "n", "names", F.posexplode("covariance").alias("i", "v"))
    size = F.size("names")
    return found.select("recording", F.get("names", F.floor(F.col("i") / size).cast("int")).alias("a"), F.get("names", (F.col("i") % size).cast("int")).alias("b"), "n", F.col("v").alias("covariance"))


@register("typed_pipeline", f"""WITH {SIG}, r AS (SELECT recording, channel, sample, CASE WHEN channel IN ('disc', 'price', 'qty') AND sample BETWEEN 20 AND 299 THEN value - avg(CASE WHEN channel IN ('disc', 'qty') THEN value END) OVER (PARTITION BY recording, sample) ELSE value END AS value FROM sig),
t AS (SELECT recording, 'eog' AS channel, sample, price AS value FROM wide UNION ALL SELECT recording, 'STI', sample, tax * 100 FROM wide UNION ALL SELECT recording, channel, sample, value FROM r WHERE channel IN ('disc', 'price', 'qty'))
SELECT recording, channel, CAST(sample - 20 AS BIGINT) AS sample, {r6('value')} AS value FROM t WHERE sample BETWEEN 20 AND 299""")
def _(spark, d):
    """A reference with an EOG and a trigger channel, which it leaves as they are, and a bad one, which it doesn't pool."""
    s = sig(spark, d)
    more = [s.where(f"channel = '{c}'").select("recording", F.lit(n).alias("channel"), "sample", (F.col("value") * k).alias("value")) for c, n, k in (("price", "eog", 1), ("tax", "STI", 100))]
    s = s.where("channel <> 'tax'").unionByName(more[0]).unionByName(more[1])
    steps = [{"crop": {"tmin": 0.2, "tmax": 3.0}}, {"set_channel_types": {"types": {"eog": "eog", "STI": "stim"}}}, {"set_bads": {"channels": ["price"]}}, "reference"]
    return Pipeline.from_config(steps).run(s, RATE).samples


@register("bad_channels_with_positions")
def _(spark, d):
    """All criteria, prediction from neighbours too, over caps of 64 channels; every window is looked at."""
    at = _positions(spark)
    table = cap(spark, d).select(*signals.KEY).distinct().join(at, "channel")
    return bad_channels.find_bad_channels(cap(spark, d), 64.0, table, ransac_windows=1 << 30).drop("deviation_z", "hf_noise_z")


@register("cleaning_pipeline")
def _(spark, d):
    steps = [{"filter": {"low": 1.0, "high": 40.0}}, {"notch": {"frequency": "auto"}}, {"set_bads": {"channels": ["price"]}}, "reference", {"resample": {"sfreq": 50.0}}]
    return Pipeline.from_config(steps).run(sig(spark, d), RATE).samples


@register("recommendations")
def _(spark, d):
    return report.recommendations(quality.assess(sig(spark, d), RATE))


@register("simulated_quality")
def _(spark, d):
    """Simulated recordings with planted faults, as many as there are nations."""
    n = _read(spark, d, "nation").count()
    eleven = ["Fp1", "Fp2", "F3", "F4", "C3", "Cz", "C4", "P3", "P4", "O1", "O2"]
    made = kept(simulate(spark, n, eleven, 12.0, 128.0, {"C3": "noisy", "O2": "flat"}))
    return quality.assess(made, 128.0, 50.0).select("recording", "channel", "score", "grade", "rank")
