"""Previews, fingerprints, ranges, thinning rules, category maps, spillover and bead pipelines."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cytora.functions import exprs as X
from cytora.operators import beads, hist, normalise, ordered, spectra, stats, surgery
from cytora.plans.adapters import ITEM_KEY, ITEMS_SQL, KEY_SQL, TIMED_SQL, P, Q, items, keyed_items, norm_sql, timed
from cytora.plans.reference import query
from cytora.session import table

r6 = lambda c: F.round(c, 6)

_ASINH = "asinh(p / 150.0)"


@query(f"WITH {ITEMS_SQL}, b AS (SELECT sample_id, CAST(floor(({_ASINH} - 2.0) / 6.0 * 200) AS INTEGER) AS bin FROM ev), c AS (SELECT sample_id, bin, count(*) AS n FROM b WHERE bin BETWEEN 0 AND 199 GROUP BY ALL) SELECT sample_id, bin, round(150 * sinh(2.0 + (bin + 0.5) * 0.03), 4) AS x, round(n / sum(n) OVER (PARTITION BY sample_id), 9) AS share FROM c")
def preview_hist(spark, d):
    """Histogram on the transformed axis with bin centres back in data units, over all events instead of a sample."""
    x = X.arcsinh(F.col("p") / 150.0)
    h = hist.shares(hist.counted(items(spark, d), ["sample_id"], hist.fit_bin(x, 2.0, 8.0, 200)), ["sample_id"])
    return h.select("sample_id", "bin", F.round(150 * F.sinh(2.0 + (F.col("bin") + 0.5) * 0.03), 4).alias("x"), F.round("share", 9).alias("share"))


@query("WITH m AS (SELECT label, i, quantile_cont(CAST(embedding[i] AS DOUBLE), 0.5) AS v FROM embeddings, range(1, 65) t(i) GROUP BY label, i), k AS (SELECT label, arg_max(i, (abs(v), -i)) AS peak, max(abs(v)) AS top FROM m GROUP BY label) SELECT label, CAST(i - 1 AS INTEGER) AS detector, round(CASE WHEN i = peak THEN 1.0 ELSE v / top END, 6) AS level FROM m JOIN k USING (label)")
def fingerprint(spark, d):
    """Medians of every detector over that of the peak detector, whose level is 1."""
    m = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("detector", "v"))
    m = stats.exact_medians(m, ["label", "detector"], ["v"])
    peak = m.groupBy("label").agg(F.max_by("detector", F.struct(F.abs("v"), -F.col("detector"))).alias("peak"), F.max(F.abs("v")).alias("top"))
    level = F.when(F.col("detector") == F.col("peak"), 1.0).otherwise(F.col("v") / F.col("top"))
    return m.join(peak, "label").select("label", "detector", r6(level).alias("level"))


@query("WITH e AS (SELECT CAST(i - 1 AS INTEGER) AS detector, CAST(embedding[i] AS DOUBLE) * 1000 AS v FROM embeddings, range(1, 65) t(i)), y AS (SELECT detector, CASE WHEN v <= 0 THEN 0 WHEN v <= 1000 THEN v / 1000 ELSE 1 + log10(v / 1000) END AS y FROM e) SELECT detector, CAST(least(floor(y / 4 * 96), 95) AS INTEGER) AS bin, count(*) AS n FROM y GROUP BY ALL")
def spectral_density(spark, d):
    """Counts of each detector in 96 levels of the display scale."""
    e = table(spark, d, "embeddings").select(F.posexplode("embedding").alias("detector", "v"))
    y = X.spectral_display(F.col("v").cast("double") * 1000)
    return e.select("detector", F.least(F.floor(y / 4 * 96), F.lit(95)).cast("int").alias("bin")).groupBy("detector", "bin").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {ITEMS_SQL}, i AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY {KEY_SQL}) - 1 AS idx, count(*) OVER (PARTITION BY sample_id) AS n FROM ev), k AS (SELECT *, ceil(idx * 5000.0 / n) AS i FROM i) SELECT sample_id, round(avg(q), 6) AS mean_q, round(avg(d), 9) AS mean_d, CASE WHEN avg(q) >= avg(d) THEN 'q' ELSE 'd' END AS brightest FROM k WHERE n <= 5000 OR (i < 5000 AND floor(i * n / 5000.0) = idx) GROUP BY sample_id")
def stratified_mean(spark, d):
    """Means over at most 5 000 evenly spaced events, and the channel with the largest."""
    rows = ordered.row_index(keyed_items(spark, d).select(*ITEM_KEY, "sample_id", "q", "d"), ITEM_KEY, "idx", "sample_id", "n")
    thin = surgery.stride(rows, "idx", F.col("n"), 5000)
    mq, md = F.avg(stats.kept(F.col("q"))), F.avg(stats.kept(F.col("d")))
    return thin.groupBy("sample_id").agg(r6(mq).alias("mean_q"), F.round(md, 9).alias("mean_d"), F.when(mq >= md, "q").otherwise("d").alias("brightest"))


@query(f"WITH {ITEMS_SQL}, i AS (SELECT sample_id, q, row_number() OVER (PARTITION BY sample_id ORDER BY {KEY_SQL}) - 1 AS idx, count(*) OVER (PARTITION BY sample_id) AS n FROM ev) SELECT sample_id, CAST(idx AS BIGINT) AS event_idx, q FROM i WHERE idx % greatest(1, n // 2500) = 0")
def step_sample(spark, d):
    """Every k-th event, k so that about 2 500 remain."""
    rows = ordered.row_index(keyed_items(spark, d).select(*ITEM_KEY, "sample_id", "q"), ITEM_KEY, "event_idx", "sample_id", "n")
    return rows.filter(F.col("event_idx") % F.greatest(F.lit(1), F.floor(F.col("n") / 2500)) == 0).select("sample_id", F.col("event_idx").cast("long").alias("event_idx"), "q")


@query(f"WITH {TIMED_SQL}, r AS (SELECT min(time) AS lo, max(time) AS hi FROM ev) SELECT sample_id, CAST(least(floor((time - lo) / (hi - lo) * 120), 119) AS INTEGER) AS pixel, round(avg(value), 6) AS mean_value, count(*) AS n FROM ev, r GROUP BY ALL")
def time_strip(spark, d):
    """Mean of a channel for each pixel column of time."""
    rows = timed(spark, d)
    lo, hi = rows.agg(F.min("time"), F.max("time")).first()
    pixel = F.least(F.floor((F.col("time") - F.lit(lo)) / F.lit(hi - lo) * 120), F.lit(119)).cast("int")
    return rows.groupBy("sample_id", pixel.alias("pixel")).agg(r6(F.avg("value")).alias("mean_value"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {ITEMS_SQL} SELECT sample_id, round(quantile_cont(p, 0.0001), 4) AS low, round(quantile_cont(p, 0.999), 4) AS high FROM ev GROUP BY sample_id")
def display_bounds(spark, d):
    q = stats.exact_quantiles(items(spark, d), ["sample_id"], ["p"], [0.0001, 0.999])
    return q.select("sample_id", F.round(F.col("q")[0], 4).alias("low"), F.round(F.col("q")[1], 4).alias("high"))


@query(f"WITH {ITEMS_SQL}, r AS (SELECT min(p) AS lo, max(p) AS hi, asinh(min(p) / 150.0) AS a, asinh(max(p) / 150.0) AS b FROM ev) SELECT 'linear' AS axis, round(least(-0.1, lo), 4) AS low, round(greatest(1.1, hi), 4) AS high FROM r UNION ALL SELECT 'arcsinh', round(150 * sinh(a - 0.1 * (b - a)), 4), round(150 * sinh(b + 0.1 * (b - a)), 4) FROM r")
def plot_range(spark, d):
    """Ranges that hold the data of all sources: on a linear axis, and with a tenth of the span on both sides of a transformed one."""
    lo, hi = items(spark, d).agg(F.min(stats.kept(F.col("p"))), F.max(stats.kept(F.col("p")))).first()
    a, b = math.asinh(lo / 150), math.asinh(hi / 150)
    wide = lambda v: round(150 * math.sinh(v), 4)
    return spark.createDataFrame([("linear", round(min(-0.1, lo), 4), round(max(1.1, hi), 4)), ("arcsinh", wide(a - 0.1 * (b - a)), wide(b + 0.1 * (b - a)))], "axis string, low double, high double")


@query(f"WITH {ITEMS_SQL} SELECT sample_id, " + ", ".join(f"round(quantile_cont({c}, 0.5), 6) AS {c}" for c in "qpdt") + " FROM ev WHERE q >= 10 AND q <= 40 GROUP BY sample_id")
def control_medians(spark, d):
    """Medians of every channel over the events of a control's positive range (either order of the ends)."""
    lo, hi = sorted((40.0, 10.0))
    inside = X.at_least(F.col("q"), lo) & X.at_most(F.col("q"), hi)
    return stats.exact_medians(items(spark, d).filter(inside), ["sample_id"], list("qpdt")).select("sample_id", *[r6(F.col(c)).alias(c) for c in "qpdt"])


@query(f"WITH {ITEMS_SQL} SELECT sample_id, count(*) AS shown FROM ev WHERE {norm_sql('q', Q)} BETWEEN 0 AND 1 AND {norm_sql('p', P)} BETWEEN 0 AND 0.5 GROUP BY 1")
def plot_clip(spark, d):
    """Events within the plotted area."""
    x, y = Q.normalised(F.col("q")), P.normalised(F.col("p"))
    inside = X.at_least(x, 0.0) & X.at_most(x, 1.0) & X.at_least(y, 0.0) & X.at_most(y, 0.5)
    return items(spark, d).filter(inside).groupBy("sample_id").agg(F.count(F.lit(1)).alias("shown"))


@query("WITH old AS (SELECT event_type AS label, CAST(row_number() OVER (ORDER BY event_type) - 1 AS INTEGER) AS id FROM (SELECT DISTINCT event_type FROM events WHERE event_type <= 'p')), new AS (SELECT event_type AS label, min(event_id) AS f FROM events GROUP BY 1), added AS (SELECT label, CAST((SELECT max(id) FROM old) + row_number() OVER (ORDER BY f) AS INTEGER) AS id FROM new WHERE label NOT IN (SELECT label FROM old)) SELECT label, id FROM old UNION ALL SELECT label, id FROM added")
def category_remap(spark, d):
    """Category ids after labels are written a second time: known labels keep theirs, new ones follow the largest."""
    rows = table(spark, d, "events").select(F.col("event_type").alias("label"), "event_id")
    old = rows.filter("label <= 'p'").select("label").distinct().withColumn("id", (F.row_number().over(Window.orderBy("label")) - 1).cast("int"))  # labels only
    first = rows.groupBy("label").agg(F.min("event_id").alias("f")).join(old.select("label"), "label", "left_anti")
    top = old.agg(F.max("id")).first()[0]
    added = first.select("label", (F.lit(-1 if top is None else top) + F.row_number().over(Window.orderBy("f"))).cast("int").alias("id"))
    return old.unionByName(added)


@query("SELECT channel_name AS name, mass_number AS mass, mass_element AS element, CAST(row_number() OVER (ORDER BY mass_number, mass_element, channel_name) - 1 AS INTEGER) AS place FROM (SELECT DISTINCT channel_name, mass_number, mass_element FROM channels WHERE channel_kind = 'Mass' AND mass_number IS NOT NULL AND mass_element IS NOT NULL)")
def mass_order(spark, d):
    """Mass channels by mass, element and name."""
    c = table(spark, d, "channels").filter("channel_kind = 'Mass' AND mass_number IS NOT NULL AND mass_element IS NOT NULL").select(F.col("channel_name").alias("name"), F.col("mass_number").alias("mass"), F.col("mass_element").alias("element")).distinct()
    return ordered.row_index(c, ["mass", "element", "name"], "place").select("name", "mass", "element", F.col("place").cast("int").alias("place"))


def _spill_sql() -> str:
    rows = []
    for sample, a in zip(("A", "N", "R"), "qpd"):
        for b in "qpd":
            rows.append(f"SELECT '{a}' AS source, '{b}' AS receiver, " + ("1.0" if a == b else f"coalesce((SELECT regr_slope({b}, {a}) FROM ev WHERE sample_id = '{sample}' AND q >= 10), 0.0)") + " AS value")
    return f"WITH {ITEMS_SQL}, m AS ({' UNION ALL '.join(rows)}) SELECT source, receiver, round(value, 6) AS value FROM m"


@query(_spill_sql())
def spillover_matrix(spark, d):
    """Source x receiver matrix from the slopes of three single-stain controls; registered, not applied."""
    channels = ["q", "p", "d"]
    control = dict(zip(("A", "N", "R"), channels))
    rows = items(spark, d).filter(X.at_least(F.col("q"), 10.0))
    sums = {r["sample_id"]: r for r in rows.groupBy("sample_id").agg(*[F.regr_slope(b, a).alias(f"{a}_{b}") for a in channels for b in channels if a != b]).collect()}
    m = np.eye(3)
    for sample, source in control.items():
        for j, receiver in enumerate(channels):
            if receiver != source and sample in sums:
                m[channels.index(source), j] = sums[sample][f"{source}_{receiver}"] or 0.0
    return spark.createDataFrame([(a, b, round(float(m[i, j]), 6)) for i, a in enumerate(channels) for j, b in enumerate(channels)], "source string, receiver string, value double")


def normalised_beads(events: DataFrame, sample: str, time: str, value: str, order: list[str], reference: float) -> DataFrame:
    """Events with ``value`` brought to the reference: bead window, time bins of bead medians, drift factor at every event's time."""
    window = beads.isotope_window(events, sample, value)
    bead = events.join(window, sample).filter(X.at_least(F.col(value), F.col("low")) & X.at_most(F.col(value), F.col("high"))).drop("low", "high")
    bins = beads.time_bins(bead, sample, time, [value], order).filter(F.col(value) > 0)
    knots = bins.select(sample, F.col(time).alias("_kt"), F.col(value).alias("_kv"))
    at = beads.asof_interpolate(events, knots, [sample], time, "_kt", "_kv", "_median")
    return at.withColumn("normalised", F.when(F.col("_median") > 0, (F.col(value) * reference / F.col("_median")).cast("float")).otherwise(F.col(value).cast("float"))).drop("_median")


_BEAD_SQL = """win AS (SELECT sample_id, 2 * quantile_cont(value, 0.5) - any_value(high) AS low, any_value(high) AS high FROM ev JOIN (SELECT sample_id, max(value) AS high FROM ev GROUP BY 1) h USING (sample_id) WHERE value >= high / 2 GROUP BY sample_id),
i AS (SELECT sample_id, time, value, row_number() OVER (PARTITION BY sample_id ORDER BY time, event_id) - 1 AS k, count(*) OVER (PARTITION BY sample_id) AS n FROM ev JOIN win USING (sample_id) WHERE value >= low AND value <= high),
z AS (SELECT *, ceil(n / least(200, least(greatest(2, CAST(round_even(n / 50.0, 0) AS BIGINT)), greatest(2, floor(n / 10))))) AS size FROM i WHERE n >= 20),
y AS (SELECT *, floor(k / size) AS b, floor((n - 1) / size) AS last FROM z),
x AS (SELECT *, CASE WHEN n - last * size < 25 AND last = 1 THEN CASE WHEN k >= n // 2 THEN 1 ELSE 0 END WHEN n - last * size < 25 AND last > 0 AND b = last THEN last - 1 ELSE b END AS bin FROM y),
tb AS (SELECT * FROM (SELECT sample_id, quantile_cont(time, 0.5) AS t, quantile_cont(value, 0.5) AS v FROM x GROUP BY sample_id, bin) WHERE v > 0),
sp AS (SELECT sample_id, t AS t0, v AS v0, lead(t) OVER w AS t1, lead(v) OVER w AS v1 FROM tb WINDOW w AS (PARTITION BY sample_id ORDER BY t)),
en AS (SELECT sample_id, min(t) AS lo, max(t) AS hi, arg_min(v, t) AS vlo, arg_max(v, t) AS vhi FROM tb GROUP BY 1),
md AS (SELECT ev.sample_id, ev.value, CASE WHEN time <= lo THEN vlo WHEN time >= hi THEN vhi ELSE v0 + (time - t0) * (v1 - v0) / (t1 - t0) END AS m FROM ev LEFT JOIN en ON en.sample_id = ev.sample_id LEFT JOIN sp ON sp.sample_id = ev.sample_id AND time >= t0 AND time < t1 AND time > lo AND time < hi)"""


@query(f"WITH {TIMED_SQL}, {_BEAD_SQL} SELECT sample_id, count(*) AS n, round(avg(value), 3) AS before, round(avg(CAST(CAST(CASE WHEN m > 0 THEN value * 400.0 / m ELSE value END AS FLOAT) AS DOUBLE)), 3) AS after FROM md GROUP BY 1")
def bead_normalisation(spark, d):
    """Means before and after the whole bead pipeline."""
    done = normalised_beads(timed(spark, d), "sample_id", "time", "value", ["event_id"], 400.0)
    return done.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 3).alias("before"), F.round(F.avg("normalised"), 3).alias("after"))


@query("SELECT p_type AS label, lower(replace(p_type, ' ', '_')) AS key, count(*) AS n, CAST(max(length(p_name)) AS INTEGER) AS longest FROM part GROUP BY ALL")
def label_text(spark, d):
    """String functions on labels."""
    rows = table(spark, d, "part")
    return rows.groupBy(F.col("p_type").alias("label"), F.lower(F.replace("p_type", F.lit(" "), F.lit("_"))).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.max(F.length("p_name")).alias("longest"))


# --- spectral pipeline -----------------------------------------------------------------------------------------


def _controls(spark, d) -> DataFrame:
    """Spectral controls: the first two entries are scatter, the others detectors; label 0 is the blank."""
    e = table(spark, d, "embeddings")
    return e.select(F.col("label").cast("string").alias("control"), F.col("vec_id").alias("event"), F.slice("embedding", 1, 2).alias("scatter"), F.slice("embedding", 3, F.size("embedding") - 2).alias("detectors"))


_SIGNATURES = """
e AS (SELECT CAST(label AS VARCHAR) AS control, vec_id AS event, CAST(embedding[1] AS DOUBLE) AS sx, CAST(embedding[2] AS DOUBLE) AS sy, embedding[3:] AS det FROM embeddings),
nb AS (SELECT *, row_number() OVER (PARTITION BY control ORDER BY event) - 1 AS idx, count(*) OVER (PARTITION BY control) AS n FROM e),
few AS (SELECT * FROM (SELECT *, ceil(idx * 3000.0 / n) AS k FROM nb WHERE control = '0') WHERE n <= 3000 OR (k < 3000 AND floor(k * n / 3000.0) = idx)),
pe AS (SELECT * FROM (SELECT *, ceil(idx * 5000.0 / n) AS k FROM nb WHERE control <> '0') WHERE n <= 5000 OR (k < 5000 AND floor(k * n / 5000.0) = idx)),
bm AS (SELECT i, avg(CAST(det[i] AS DOUBLE)) AS b FROM few, range(1, 63) t(i) GROUP BY i),
un AS (SELECT i, b / (SELECT sqrt(sum(b * b)) FROM bm) AS u FROM bm),
sm AS (SELECT control, i, avg(CAST(det[i] AS DOUBLE)) AS v FROM pe, range(1, 63) t(i) GROUP BY control, i),
dt AS (SELECT control, sum(v * u) AS dot FROM sm JOIN un USING (i) GROUP BY control),
pk AS (SELECT control, arg_min(i, (-(v - dot * u), i)) AS peak FROM sm JOIN un USING (i) JOIN dt USING (control) GROUP BY control),
lv AS (SELECT p.peak, quantile_cont(CAST(det[p.peak] AS DOUBLE), 0.99) AS lvl FROM e, (SELECT DISTINCT peak FROM pk) p WHERE control = '0' GROUP BY p.peak),
po AS (SELECT * FROM (SELECT e.*, row_number() OVER (PARTITION BY control ORDER BY det[peak] DESC, event) AS r FROM e JOIN pk USING (control) JOIN lv USING (peak) WHERE CAST(det[peak] AS DOUBLE) > lvl) WHERE r <= 3000),
nn AS (SELECT * FROM (SELECT po.control, po.event, few.event AS blank, row_number() OVER (PARTITION BY po.control, po.event ORDER BY (po.sx - few.sx) * (po.sx - few.sx) + (po.sy - few.sy) * (po.sy - few.sy), few.event) AS r FROM po, few) WHERE r <= 2),
bg AS (SELECT nn.control, nn.event, i, avg(CAST(few.det[i] AS DOUBLE)) AS b FROM nn JOIN few ON few.event = nn.blank, range(1, 63) t(i) GROUP BY ALL),
co AS (SELECT po.control, i, CAST(CAST(po.det[i] AS DOUBLE) - b AS FLOAT) AS v FROM po JOIN bg ON bg.control = po.control AND bg.event = po.event),
md AS (SELECT control, i, quantile_cont(CAST(v AS DOUBLE), 0.5) AS v FROM co GROUP BY ALL),
sg AS (SELECT control, i, greatest(0, v / max(v) OVER (PARTITION BY control)) AS s FROM md UNION ALL SELECT 'AF', i, v / max(v) OVER () FROM (SELECT i, quantile_cont(CAST(det[i] AS DOUBLE), 0.5) AS v FROM few, range(1, 63) t(i) GROUP BY i))"""


@query(f"WITH {_SIGNATURES} SELECT control, CAST(i - 1 AS INTEGER) AS detector, round(CAST(s AS FLOAT), 5) AS signature FROM sg WHERE s IS NOT NULL")
def spectral_pipeline(spark, d):
    """Signatures of all controls: peaks, positives above the blank, the two nearest blanks taken off, medians over the largest."""
    s = spectra.signatures(_controls(spark, d), "control", "event", "scatter", "detectors", "0").filter("signature IS NOT NULL")
    return s.select("control", "detector", F.round("signature", 5).alias("signature"))


@query()
def spectral_fit(spark, d):
    """Unmixing coefficients of every molecule from the whole pipeline, with the similarity of its signature to the nearest other."""
    rows = _controls(spark, d)
    labels = [r["control"] for r in rows.select("control").distinct().collect() if r["control"] != "0"]  # controls only
    names, _, similar, m = spectra.fit(rows, "control", "event", "scatter", "detectors", ["0"], {c: f"molecule {c}" for c in sorted(labels)}, lenient=True)
    np.fill_diagonal(similar, -1)
    out = [(n, int(j), float(m[i, j]), float(similar[i].max())) for i, n in enumerate(names) for j in range(m.shape[1])]
    return spark.createDataFrame(out, "molecule string, detector int, coefficient double, nearest double")


# --- beads of several isotopes ---------------------------------------------------------------------------------

_ISOTOPES = [normalise.Isotope(140, "p", 90000.0), normalise.Isotope(175, "q", 45.0)]


def _mass_items(spark, d) -> DataFrame:
    """Items with a time, two isotopes of a bead (p and q) and another mass channel (d)."""
    return keyed_items(spark, d).withColumn("time", F.unix_date(F.col("l_shipdate").cast("date")).cast("double"))


def _isotope_sql(c: str, m: int) -> str:
    return f"a{m} AS (SELECT sample_id, max({c}) AS hi FROM ev GROUP BY 1), w{m} AS (SELECT sample_id, 2 * quantile_cont({c}, 0.5) - any_value(hi) AS low{m}, any_value(hi) AS high{m} FROM ev JOIN a{m} USING (sample_id) WHERE {c} >= hi / 2 GROUP BY sample_id)"


_FACTOR = "CASE WHEN tm <= lo THEN {c}lo WHEN tm >= hi THEN {c}hi ELSE {c}0 + (tm - t0) * ({c}1 - {c}0) / (t1 - t0) END"
_BEADS_SQL = f"""{_isotope_sql('p', 140)}, {_isotope_sql('q', 175)},
mk AS (SELECT ev.*, CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS DOUBLE) AS tm, p >= low140 AND p <= high140 AND q >= low175 AND q <= high175 AS is_bead, p >= low140 AND q >= low175 AS is_removed FROM ev JOIN w140 USING (sample_id) JOIN w175 USING (sample_id)),
i AS (SELECT sample_id, tm, p, q, row_number() OVER (PARTITION BY sample_id ORDER BY tm, {KEY_SQL}) - 1 AS k, count(*) OVER (PARTITION BY sample_id) AS n FROM mk WHERE is_bead),
z AS (SELECT *, ceil(n / least(200, least(greatest(2, CAST(round_even(n / 50.0, 0) AS BIGINT)), greatest(2, floor(n / 10))))) AS size FROM i WHERE n >= 20),
y AS (SELECT *, floor(k / size) AS b, floor((n - 1) / size) AS last FROM z),
x AS (SELECT *, CASE WHEN n - last * size < 25 AND last = 1 THEN CASE WHEN k >= n // 2 THEN 1 ELSE 0 END WHEN n - last * size < 25 AND last > 0 AND b = last THEN last - 1 ELSE b END AS bin FROM y),
tb AS (SELECT sample_id, quantile_cont(tm, 0.5) AS t, quantile_cont(p, 0.5) AS p, quantile_cont(q, 0.5) AS q FROM x GROUP BY sample_id, bin),
sp AS (SELECT sample_id, t AS t0, p AS p0, q AS q0, lead(t) OVER w AS t1, lead(p) OVER w AS p1, lead(q) OVER w AS q1 FROM tb WINDOW w AS (PARTITION BY sample_id ORDER BY t)),
en AS (SELECT sample_id, min(t) AS lo, max(t) AS hi, arg_min(p, t) AS plo, arg_max(p, t) AS phi, arg_min(q, t) AS qlo, arg_max(q, t) AS qhi FROM tb GROUP BY 1),
md AS (SELECT mk.*, 90000.0 / ({_FACTOR.format(c='p')}) AS f140, 45.0 / ({_FACTOR.format(c='q')}) AS f175 FROM (SELECT mk.sample_id, mk.tm, mk.p AS vp, mk.q AS vq, mk.d AS vd, is_removed, en.* EXCLUDE (sample_id) FROM mk JOIN en USING (sample_id)) mk LEFT JOIN sp ON sp.sample_id = mk.sample_id AND tm >= t0 AND tm < t1 AND tm > lo AND tm < hi)"""


@query(f"WITH {ITEMS_SQL}, {_BEADS_SQL} SELECT sample_id, count(*) AS n, round(avg(CAST(vp * f140 AS FLOAT)), 1) AS p, round(avg(CAST(vq * f175 AS FLOAT)), 3) AS q, round(avg(CAST(vd * (f140 + (f175 - f140) * (13.0 / 35.0)) AS FLOAT)), 5) AS d FROM md WHERE NOT is_removed GROUP BY 1")
def bead_isotopes(spark, d):
    """Mass channels brought to the references of beads in two isotopes, factors straight in mass, beads left out."""
    done = normalise.normalised(_mass_items(spark, d), "sample_id", "time", _ISOTOPES, {"p": 140, "q": 175, "d": 153}, ITEM_KEY, remove=True)
    mean = lambda c, k: F.round(F.avg(F.col(c).cast("double")), k).alias(c)
    return done.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"), mean("p", 1), mean("q", 3), mean("d", 5))
