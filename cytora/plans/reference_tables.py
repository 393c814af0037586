"""Quantiles, sample surgery, demultiplexing, beads, spectra and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cytora.functions import exprs as X

from cytora.operators import beads, compare, integrate, ordered, platforms, spectra, stats, surgery
from cytora.plans.adapters import ITEM_KEY, ITEMS_SQL, KEY_SQL, TIMED_SQL, items, keyed_items, timed
from cytora.plans.reference import query
from cytora.session import table

r6 = lambda c: F.round(c, 6)
r4 = lambda c: F.round(c, 4)
PROBS = [0.1, 0.25, 0.5, 0.75, 0.9]
TENTHS = [round(i / 10, 1) for i in range(1, 10)]

# --- quantiles -------------------------------------------------------------------------------------------------


def _exploded(aggregated: DataFrame, keys: list[str], column: str, probs: list[float]) -> DataFrame:
    p = F.array(*[F.lit(v) for v in probs])
    return aggregated.select(*keys, F.inline(F.arrays_zip(p.alias("p"), F.col(column).alias("v"))).alias("p", "value"))


@query(f"WITH {ITEMS_SQL}, q AS (SELECT sample_id, unnest({PROBS}) AS p, unnest(quantile_cont(p, {PROBS})) AS value FROM ev GROUP BY sample_id) SELECT sample_id, CAST(p AS DOUBLE) AS p, round(value, 4) AS value FROM q")
def quantiles_type7(spark, d):
    q = stats.exact_quantiles(items(spark, d), ["sample_id"], ["p"], PROBS)
    return _exploded(q, ["sample_id"], "q", PROBS).select("sample_id", "p", r4(F.col("value")).alias("value"))


_BATCH = " UNION ALL ".join(f"SELECT batch, '{c}' AS channel, unnest({TENTHS}) AS p, unnest(quantile_cont({c}, {TENTHS})) AS value FROM ev GROUP BY batch HAVING count(*) >= 50" for c in "qpd")


def _batch_quantiles(spark, d) -> DataFrame:
    q = integrate.batch_quantiles(items(spark, d), "batch", list("qpd"), TENTHS)
    return _exploded(q, ["batch", "channel"], "q", TENTHS)


@query(f"WITH {ITEMS_SQL}, b AS ({_BATCH}) SELECT batch, channel, CAST(p AS DOUBLE) AS p, round(value, 4) AS value FROM b")
def batch_quantiles(spark, d):
    return _batch_quantiles(spark, d).select("batch", "channel", "p", r4(F.col("value")).alias("value"))


@query(f"WITH {ITEMS_SQL}, b AS ({_BATCH}) SELECT channel, CAST(p AS DOUBLE) AS p, round(avg(value), 4) AS goal FROM b GROUP BY ALL")
def goal_quantiles(spark, d):
    q = integrate.batch_quantiles(items(spark, d), "batch", list("qpd"), TENTHS)
    return _exploded(integrate.goal_quantiles(q), ["channel"], "goal", TENTHS).select("channel", "p", r4(F.col("value")).alias("goal"))


@query(f"WITH {ITEMS_SQL}, b AS ({_BATCH}) SELECT channel, CAST(p AS DOUBLE) AS p, round(quantile_cont(value, 0.5), 4) AS goal FROM b GROUP BY ALL")
def goal_medians(spark, d):
    """Medians over batches of their quantiles."""
    q = integrate.batch_quantiles(items(spark, d), "batch", list("qpd"), TENTHS)
    return _exploded(integrate.goal_quantiles(q, "median"), ["channel"], "goal", TENTHS).select("channel", "p", r4(F.col("value")).alias("goal"))


@query(f"WITH {ITEMS_SQL}, c AS (SELECT batch, CAST(floor(d * 100) AS INTEGER) AS cluster, unnest({TENTHS}) AS pr, unnest(quantile_cont(p, {TENTHS})) AS value FROM ev GROUP BY batch, 2 HAVING count(*) >= 50) SELECT batch, cluster, CAST(pr AS DOUBLE) AS p, round(value, 1) AS value FROM c")
def cluster_quantiles(spark, d):
    """Quantiles of a channel in every cluster of every batch."""
    rows = items(spark, d).withColumn("cluster", F.floor(F.col("d") * 100).cast("int"))
    q = integrate.batch_quantiles(rows, "batch", ["p"], TENTHS, "cluster")
    return _exploded(q, ["batch", "cluster"], "q", TENTHS).select("batch", "cluster", "p", F.round("value", 1).alias("value"))


@query(f"WITH {ITEMS_SQL}, m AS (SELECT sample_id, quantile_cont(p, 0.5) AS md FROM ev GROUP BY sample_id) SELECT sample_id, round(1.4826 * quantile_cont(abs(p - md), 0.5), 4) AS mad FROM ev JOIN m USING (sample_id) GROUP BY sample_id")
def mad_by_group(spark, d):
    rows = items(spark, d)
    return stats.scaled_mad(rows, "sample_id", "p").select("sample_id", r4(F.col("mad")).alias("mad"))


def _distances(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(a, b, distance): earth mover's distances of all pairs of groups, on counts of bins of one grid per pair.

    Pairs share few grids; every group is binned once on each of its grids, and only filled bins meet partners.
    """
    ends = rows.groupBy(group).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(F.lit(1)).alias("n"))
    one = ends.select(F.col(group).alias("a"), F.col("lo").alias("alo"), F.col("hi").alias("ahi"), F.col("n").alias("an"))
    two = ends.select(F.col(group).alias("b"), F.col("lo").alias("blo"), F.col("hi").alias("bhi"), F.col("n").alias("bn"))
    pairs = one.join(two, F.col("a") < F.col("b"))  # groups against groups: a handful of labels
    lo, hi = F.least("alo", "blo"), F.greatest("ahi", "bhi")
    pairs = pairs.select("a", "b", "an", "bn", F.when(lo > -100, -99.0).otherwise(lo).alias("lo"), F.when(hi < 100, 99.0).otherwise(hi).alias("hi"))
    pairs = pairs.withColumn("w", F.greatest(F.lit(0.1), 1e-4 * F.pow(F.lit(10.0), F.ceil(F.log10(F.col("hi") - F.col("lo"))))))
    counted = rows.groupBy(group, value).agg(F.count(F.lit(1)).alias("c"))
    sides = pairs.select("a", "b", "lo", "hi", "w", F.inline(F.array(F.struct(F.col("a").alias("g"), (1.0 / F.col("an")).alias("sign")), F.struct(F.col("b").alias("g"), (-1.0 / F.col("bn")).alias("sign")))))
    grids = sides.select("g", "lo", "hi", "w").distinct()
    last = F.ceil((F.col("hi") - F.col("lo") + 2) / F.col("w")) - 1
    at = F.greatest(F.lit(0), F.least(F.floor((F.col(value) - (F.col("lo") - 1)) / F.col("w")), last))
    binned = counted.withColumnRenamed(group, "g").join(grids, "g").groupBy("g", "lo", "hi", "w", at.alias("bin")).agg(F.sum("c").alias("c"))
    net = binned.join(sides, ["g", "lo", "hi", "w"]).groupBy("a", "b", "w", "bin").agg(F.sum(F.col("c") * F.col("sign")).alias("net"))
    # between two filled bins the running difference stays as it is
    w = Window.partitionBy("a", "b").orderBy("bin")
    flow = net.withColumns({"run": F.sum("net").over(w), "next": F.lead("bin").over(w)})
    reach = F.sum(F.abs("run") * F.coalesce(F.col("next") - F.col("bin"), F.lit(0))) * F.first("w")
    return flow.groupBy("a", "b").agg((F.when(F.first("w") == 0.1, reach).otherwise(reach * F.first("w") / 0.1)).alias("distance"))


def _emd_sql(group: str, value: str) -> str:
    return f"""WITH {ITEMS_SQL}, e AS (SELECT {group} AS g, min({value}) AS lo, max({value}) AS hi, count(*) AS n FROM ev GROUP BY 1),
p0 AS (SELECT x.g AS a, y.g AS b, x.n AS an, y.n AS bn, least(x.lo, y.lo) AS l, greatest(x.hi, y.hi) AS h FROM e x JOIN e y ON x.g < y.g),
p1 AS (SELECT a, b, an, bn, CASE WHEN l > -100 THEN -99.0 ELSE l END AS lo, CASE WHEN h < 100 THEN 99.0 ELSE h END AS hi FROM p0),
p2 AS (SELECT *, greatest(0.1, 1e-4 * pow(10.0, ceil(log10(hi - lo)))) AS w FROM p1),
s AS (SELECT a, b, lo, hi, w, a AS g, 1.0 / an AS sg FROM p2 UNION ALL SELECT a, b, lo, hi, w, b, -1.0 / bn FROM p2),
b AS (SELECT a, b, w, greatest(0, least(floor(({value} - (lo - 1)) / w), ceil((hi - lo + 2) / w) - 1)) AS bin, sum(sg) AS net FROM ev JOIN s ON ev.{group} = s.g GROUP BY ALL),
f AS (SELECT a, b, w, bin, sum(net) OVER (PARTITION BY a, b ORDER BY bin) AS run, lead(bin) OVER (PARTITION BY a, b ORDER BY bin) AS nx FROM b)
SELECT a, b, round(sum(abs(run) * coalesce(nx - bin, 0)) * any_value(w) * CASE WHEN any_value(w) = 0.1 THEN 1 ELSE any_value(w) / 0.1 END, 4) AS distance FROM f GROUP BY a, b"""


@query(_emd_sql("batch", "q"))
def emd(spark, d):
    return _distances(items(spark, d), "batch", "q").select("a", "b", r4(F.col("distance")).alias("distance"))


@query(_emd_sql("sample_id", "p"))
def pairwise_emd(spark, d):
    return _distances(items(spark, d), "sample_id", "p").select("a", "b", r4(F.col("distance")).alias("distance"))


@query(f"WITH {ITEMS_SQL}, n AS (SELECT CAST(floor(d * 100) AS INTEGER) AS cluster, sample_id, count(*) AS n FROM ev GROUP BY ALL), t AS (SELECT sample_id, count(*) AS total FROM ev GROUP BY 1), c AS (SELECT DISTINCT cluster FROM n), g AS (SELECT c.cluster, t.sample_id, coalesce(n.n, 0) / total AS share FROM c CROSS JOIN t LEFT JOIN n ON n.cluster = c.cluster AND n.sample_id = t.sample_id) SELECT cluster, round(CASE WHEN avg(share) = 0 THEN 0 ELSE stddev_samp(share) / avg(share) END, 6) AS cv FROM g GROUP BY cluster")
def cluster_cv(spark, d):
    """Variation of each cluster's share over samples; missing shares count as 0, from sums alone."""
    rows = items(spark, d).select(F.floor(F.col("d") * 100).cast("int").alias("cluster"), "sample_id")
    n = rows.groupBy("cluster", "sample_id").agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy("sample_id").agg(F.sum("n").alias("total"))
    samples = total.count()
    share = F.col("n") / F.col("total")
    sums = n.join(total, "sample_id").groupBy("cluster").agg(F.sum(share).alias("s"), F.sum(share * share).alias("q"))
    mean = F.col("s") / samples
    variance = F.greatest((F.col("q") - samples * mean * mean) / max(samples - 1, 1), F.lit(0.0))
    return sums.select("cluster", r6(F.when(mean == 0, 0.0).otherwise(F.sqrt(variance) / mean)).alias("cv"))


def _numbered_items(spark, d) -> DataFrame:
    """Items with a number of their own; it only has to tell them apart."""
    return keyed_items(spark, d).select("*", F.xxhash64(*ITEM_KEY).alias("event_idx"))


# --- sample surgery --------------------------------------------------------------------------------------------



@query(f"WITH {TIMED_SQL}, r AS (SELECT min(time) AS lo, max(time) AS hi FROM ev), f AS (SELECT sample_id, CASE WHEN time < lo + (hi - lo) * 0.25 THEN 0 WHEN time < lo + (hi - lo) * 0.5 THEN 1 WHEN time <= hi THEN 2 END AS fragment FROM ev, r) SELECT sample_id, CAST(fragment AS INTEGER) AS fragment, count(*) AS n FROM f GROUP BY ALL")
def time_split(spark, d):
    rows = timed(spark, d)
    lo, hi = rows.agg(F.min("time"), F.max("time")).first()
    part = surgery.fragments(F.col("time"), [lo, lo + (hi - lo) * 0.25, lo + (hi - lo) * 0.5, hi])
    return rows.select("sample_id", part.alias("fragment")).filter("fragment IS NOT NULL").groupBy("sample_id", "fragment").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {TIMED_SQL}, u AS (SELECT * FROM ev WHERE sample_id = 'click' AND value >= 50 UNION ALL SELECT * FROM ev WHERE sample_id = 'purchase' AND value < 200) SELECT 'joined' AS sample_id, count(*) AS n, round(sum(value), 2) AS total, round(min(time), 3) AS first_time FROM u")
def concat_keep_time(spark, d):
    masks = {"high": X.at_least(F.col("value"), 50.0), "low": X.below(F.col("value"), 200.0)}
    rows = platforms.concatenated(timed(spark, d), masks, {"click": ["high"], "purchase": ["low"]}, "sample_id", "joined")
    return rows.agg(F.lit("joined").alias("sample_id"), F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"), F.round(F.min("time"), 3).alias("first_time"))


_STEP = "st AS (SELECT sample_id, min(CASE WHEN gap > 0 THEN gap END) AS g FROM (SELECT sample_id, time - lag(time) OVER (PARTITION BY sample_id ORDER BY time) AS gap FROM ev) GROUP BY sample_id), step AS (SELECT sample_id, least(coalesce(g, 1.0), 1.0) AS step FROM st)"


@query(f"WITH {TIMED_SQL}, {_STEP} SELECT sample_id, round(step, 5) AS step FROM step")
def time_step(spark, d):
    return surgery.time_steps(timed(spark, d), "sample_id", "time").select("sample_id", F.round("step", 5).alias("step"))


@query(f"WITH {TIMED_SQL}, {_STEP}, e AS (SELECT sample_id, min(time) AS lo, max(time) AS hi FROM ev GROUP BY 1), o AS (SELECT 'click' AS s, 1 AS k UNION ALL SELECT 'view', 2 UNION ALL SELECT 'purchase', 3), j AS (SELECT e.sample_id, lo, coalesce(sum(hi - lo + step) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shift FROM e JOIN step USING (sample_id) JOIN o ON o.s = e.sample_id) SELECT sample_id, round(min(time - lo + shift), 2) AS first_time, round(max(time - lo + shift), 2) AS last_time, count(*) AS n FROM ev JOIN j USING (sample_id) GROUP BY sample_id")
def concat_join_time(spark, d):
    joined = surgery.join_times(timed(spark, d), "sample_id", "time", ["click", "view", "purchase"])
    return joined.groupBy("sample_id").agg(F.round(F.min("joined_time"), 2).alias("first_time"), F.round(F.max("joined_time"), 2).alias("last_time"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {ITEMS_SQL}, i AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY {KEY_SQL}) - 1 AS idx, count(*) OVER (PARTITION BY sample_id) AS n FROM ev), k AS (SELECT *, ceil(idx * 500.0 / n) AS i FROM i) SELECT sample_id, CAST(idx AS BIGINT) AS event_idx, q, p FROM k WHERE n <= 500 OR (i < 500 AND floor(i * n / 500.0) = idx)")
def stride_sample(spark, d):
    rows = ordered.row_index(keyed_items(spark, d).select(*ITEM_KEY, "sample_id", "q", "p"), ITEM_KEY, "event_idx", "sample_id", "n")
    return surgery.stride(rows, "event_idx", F.col("n"), 500).select("sample_id", F.col("event_idx").cast("long").alias("event_idx"), "q", "p")


@query(f"WITH {ITEMS_SQL}, s AS (SELECT sample_id, q, p, batch, 0 AS source_id FROM ev WHERE q >= 40 UNION ALL SELECT sample_id, q, p, batch, 1 FROM ev WHERE q < 10), b AS (SELECT batch, dense_rank() OVER (ORDER BY batch) - 1 AS batch_id FROM (SELECT DISTINCT batch FROM s)) SELECT sample_id, CAST(source_id AS INTEGER) AS source_id, CAST(batch_id AS INTEGER) AS batch_id, count(*) AS n, round(sum(p), 2) AS total FROM s JOIN b USING (batch) GROUP BY ALL")
def platform_input(spark, d):
    """Rows of two populations with their source and batch numbers, features kept."""
    masks = {"high": X.at_least(F.col("q"), 40.0), "low": X.below(F.col("q"), 10.0)}
    chosen = platforms.platform_input(_numbered_items(spark, d), masks, [platforms.Source("high"), platforms.Source("low")], ["q", "p"], "sample_id", "event_idx", "batch", integration=True)
    return chosen.groupBy("sample_id", "source_id", "batch_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("p"), 2).alias("total"))


@query(f"WITH {ITEMS_SQL} SELECT sample_id, count(*) AS overlapping FROM ev WHERE q >= 20 AND q <= 30 GROUP BY sample_id")
def overlap_check(spark, d):
    """Events that two selected populations (q >= 20 and q <= 30) share."""
    masks = {"one": X.at_least(F.col("q"), 20.0), "two": X.at_most(F.col("q"), 30.0)}
    rows = platforms.source_rows(_numbered_items(spark, d), masks, [platforms.Source("one"), platforms.Source("two")], ["q"], "sample_id", "event_idx")
    return platforms.overlaps(rows, "sample_id", "event_idx").groupBy("sample_id").agg(F.count(F.lit(1)).alias("overlapping"))


@query("SELECT DISTINCT c_mktsegment AS label, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS INTEGER) AS batch_id FROM customer")
def batch_id(spark, d):
    return surgery.batch_ids(table(spark, d, "customer").select(F.col("c_mktsegment").alias("label")), "label").select("label", "batch_id").distinct()


@query("SELECT n_name AS sample, n_nationkey AS k, CASE WHEN r_regionkey < 3 THEN r_name END AS region FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")
def metadata_join(spark, d):
    old = table(spark, d, "nation").select(F.col("n_name").alias("sample"), F.col("n_nationkey").alias("k"), F.lit("old").alias("gone"), F.col("n_regionkey").alias("r"))
    new = old.join(table(spark, d, "region").filter("r_regionkey < 3").withColumnRenamed("r_regionkey", "r"), "r").select("sample", "k", F.col("r_name").alias("region"))
    return surgery.upsert(old, new, ["sample", "k"])


@query("SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 2) GROUP BY 1")
def batch_missing_check(spark, d):
    """Samples whose batch label is missing."""
    labels = table(spark, d, "nation").filter("n_regionkey <> 2").select(F.col("n_nationkey").alias("k"))
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).join(labels, "k", "left_anti").groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {ITEMS_SQL} SELECT sample_id, CASE WHEN d >= 0.05 THEN 'dear' WHEN q >= 25 THEN 'many' ELSE 'none' END AS population, count(*) AS n FROM ev GROUP BY ALL")
def population_embedding(spark, d):
    """Label column of a tree: the last population that holds an event gives its label."""
    masks = {"many": X.at_least(F.col("q"), 25.0), "dear": X.at_least(F.col("d"), 0.05)}
    return platforms.population_column(items(spark, d), masks, none="none").groupBy("sample_id", "population").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey AS id, round(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice * 2 ELSE o_totalprice END, 2) AS value FROM orders")
def embedding_upsert(spark, d):
    old = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("value"), "o_orderpriority")
    new = old.filter("o_orderpriority = '1-URGENT'").select("id", (F.col("value") * 2).alias("value"))
    return surgery.write_back(old, new, ["id"], "value").select("id", F.round("value", 2).alias("value"))


@query("SELECT user_id AS sample, event_type AS label, CAST(row_number() OVER (PARTITION BY user_id ORDER BY f, event_type) - 1 AS INTEGER) AS category_id FROM (SELECT user_id, event_type, min(event_id) AS f FROM events GROUP BY ALL)")
def category_encode(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("sample"), F.col("event_type").alias("label"), "event_id")
    return surgery.categories(rows, "sample", "label", "event_id")


def _sample_report(sample: DataFrame, whole: DataFrame) -> DataFrame:
    """Size of a sample, its distinct events, and how many of them the whole holds with the same value."""
    known = sample.join(whole.select(F.col("event_id").alias("i"), F.col("value").alias("v")), (F.col("event_id") == F.col("i")) & (F.col("value") == F.col("v")), "left_semi")
    return sample.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("events")).join(F.broadcast(known.agg(F.count(F.lit(1)).alias("known"))))  # one row each


@query("SELECT least(100000, count(*)) AS n, least(100000, count(*)) AS events, least(100000, count(*)) AS known FROM events")
def reservoir_cap(spark, d):
    """A uniform sample of at most 100 000 events: which ones depends on a hash, how many and that they are the table's own does not."""
    rows = timed(spark, d).select("event_id", "value")
    return _sample_report(surgery.reservoir(rows, "event_id", 100_000, 7), rows)


@query("SELECT CAST(round(0.1 * count(*)) AS BIGINT) AS n, CAST(round(0.1 * count(*)) AS BIGINT) AS events, CAST(round(0.1 * count(*)) AS BIGINT) AS known FROM events")
def subsample_rule(spark, d):
    rows = timed(spark, d).select("event_id", "value")
    return _sample_report(surgery.reservoir(rows, "event_id", max(1, round(0.1 * rows.count())), 11), rows)


@query()
def subsample(spark, d):
    """A tenth of the events, in their order."""
    rows = timed(spark, d)
    return surgery.reservoir(rows, "event_id", max(1, round(0.1 * rows.count())), 11).select("event_id", "sample_id", "value").orderBy("event_id")


@query("SELECT user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY ALL")
def json_props(spark, d):
    k = F.from_json("props", "k BIGINT")["k"]
    return table(spark, d, "events").groupBy("user_id", k.alias("k")).agg(F.count(F.lit(1)).alias("n"))


# --- demultiplexing --------------------------------------------------------------------------------------------

_MASK = "(CASE WHEN d >= 0.055 THEN 1 ELSE 0 END + CASE WHEN t >= 0.045 THEN 2 ELSE 0 END + CASE WHEN q >= 25 THEN 4 ELSE 0 END)"
_CUTOFFS = [("d", 0.055), ("t", 0.045), ("q", 25.0)]


def demux_mask(cutoffs: list[tuple[str, float]]):
    """Bit k is set where channel k reaches its cutoff; -1 where a channel is not finite. At most seven channels."""
    if not 0 < len(cutoffs) <= 7:
        raise ValueError("one to seven channels")
    bits = sum((F.when(F.col(c) >= v, F.lit(1 << k)).otherwise(0) for k, (c, v) in enumerate(cutoffs)), F.lit(0))
    sound = F.lit(True)
    for c, _ in cutoffs:
        sound = sound & X.fin(F.col(c))
    return F.when(F.coalesce(sound, F.lit(False)), bits).otherwise(-1).cast("int")


@query(f"WITH {ITEMS_SQL} SELECT l_orderkey, CAST({_MASK} AS INTEGER) AS mask, count(*) AS n FROM ev GROUP BY ALL")
def demux_classify(spark, d):
    return keyed_items(spark, d).groupBy("l_orderkey", demux_mask(_CUTOFFS).alias("mask")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {ITEMS_SQL} SELECT sample_id, CAST({_MASK} AS INTEGER) AS mask, count(*) AS n FROM ev GROUP BY ALL")
def demux_counts(spark, d):
    return items(spark, d).groupBy("sample_id", demux_mask(_CUTOFFS).alias("mask")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {ITEMS_SQL}, m AS (SELECT DISTINCT sample_id, CAST({_MASK} AS INTEGER) AS mask FROM ev), s AS (SELECT *, 'd=' || CASE WHEN mask & 1 > 0 THEN '+' ELSE '-' END || '|t=' || CASE WHEN mask & 2 > 0 THEN '+' ELSE '-' END || '|q=' || CASE WHEN mask & 4 > 0 THEN '+' ELSE '-' END AS signature FROM m) SELECT sample_id, mask, signature, sha256(sample_id || '/' || signature) AS derived_id FROM s")
def demux_signature(spark, d):
    _, meta = platforms.demultiplexed(items(spark, d), demux_mask(_CUTOFFS), [c for c, _ in _CUTOFFS], "sample_id")
    return meta.select(F.col("source_sample").alias("sample_id"), "mask", "signature", "derived_id")


def survival(df: DataFrame, group: str, value: str, points: int = 101, cofactor: float = 5.0) -> DataFrame:
    """(group, point, x, share): share of the finite, non-negative values that reach each of evenly spaced points.

    Each value counts for the points up to its own, so a count per point and a running total are enough.
    """
    good = df.filter(X.fin(F.col(value)) & (F.col(value) >= 0)).select(group, value)
    top = good.groupBy(group).agg(F.max(X.arcsinh(F.col(value) / cofactor)).alias("_top"), F.count(F.lit(1)).alias("_n")).filter("_top > 0")
    xs = top.select(group, "_top", "_n", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
    xs = xs.withColumn("x", cofactor * F.sinh(F.col("point") / float(points - 1) * F.col("_top")))
    grid = xs.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("point", "x"))), lambda s: s["x"]).alias("_xs"))
    # the last point whose x the value reaches; the estimate from the scale may be off by one at a border
    rows = good.join(grid, group).join(top, group)
    guess = F.floor(X.arcsinh(F.col(value) / cofactor) / F.col("_top") * (points - 1)).cast("int")
    at = F.greatest(F.lit(0), F.least(guess, F.lit(points - 1)))
    x = lambda k: F.element_at("_xs", k + 1)
    up = F.when((at < points - 1) & (F.col(value) >= x(F.least(at + 1, F.lit(points - 1)))), at + 1).when((at > 0) & (F.col(value) < x(at)), at - 1).otherwise(at)
    counted = rows.groupBy(group, up.alias("point")).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(group).orderBy(F.col("point").desc())
    all_points = xs.join(counted, [group, "point"], "left").withColumn("reached", F.sum(F.coalesce("c", F.lit(0))).over(w))
    return all_points.select(group, "point", "x", (F.col("reached") / F.col("_n")).alias("share"))


@query(f"WITH {ITEMS_SQL}, m AS (SELECT sample_id, max(asinh(p / 5)) AS top, count(*) AS n FROM ev WHERE p >= 0 GROUP BY 1), x AS (SELECT sample_id, n, CAST(i AS INTEGER) AS point, 5 * sinh(i / 100.0 * top) AS x FROM m, range(101) t(i)) SELECT x.sample_id, point, round((SELECT count(*) FROM ev e WHERE e.sample_id = x.sample_id AND e.p >= x.x) / n, 6) AS share FROM x WHERE point < 100")
def survival_curve(spark, d):
    return survival(items(spark, d), "sample_id", "p").filter("point < 100").select("sample_id", "point", r6(F.col("share")).alias("share"))


def subset_thresholds(counts: DataFrame, group: str, n: str) -> DataFrame:
    """(group, threshold): the count above the clearest jump between sorted counts of subsets (128 at most in a group)."""
    w = Window.partitionBy(group).orderBy(n)
    rows = counts.withColumn("_low", F.lag(n).over(w))
    ratio, gap = (F.col(n) + 1.0) / (F.col("_low") + 1.0), (F.col(n) - F.col("_low")) / F.sqrt(F.col("_low") + 1.0)
    good = rows.withColumns({"_ratio": ratio, "_gap": gap}).filter((F.col(n) >= 20) & (F.col(n) > F.col("_low")) & (F.col("_ratio") >= 3) & (F.col("_gap") >= 5))
    score = F.ln("_ratio") * F.col("_gap")
    return good.groupBy(group).agg(F.min_by(n, F.struct(-score, F.col(n))).alias("threshold"))


_SUB = "CASE WHEN q >= 45 THEN 'a' WHEN q >= 44 THEN 'b' WHEN d >= 0.095 THEN 'c' WHEN d > 0.085 AND t > 0.075 THEN 'd' WHEN q <= 1 THEN 'e' WHEN q <= 2 AND t > 0.07 THEN 'f' ELSE 'g' END"


@query(f"WITH {ITEMS_SQL}, c AS (SELECT sample_id, {_SUB} AS s, count(*) AS n FROM ev GROUP BY ALL), g AS (SELECT sample_id, n, lag(n) OVER (PARTITION BY sample_id ORDER BY n) AS low FROM c), x AS (SELECT *, (n + 1.0) / (low + 1.0) AS r, (n - low) / sqrt(low + 1.0) AS gap FROM g) SELECT sample_id, arg_min(n, (-ln(r) * gap, n)) AS threshold FROM x WHERE n >= 20 AND n > low AND r >= 3 AND gap >= 5 GROUP BY sample_id")
def subset_threshold(spark, d):
    c = items(spark, d).groupBy("sample_id", F.expr(_SUB).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    return subset_thresholds(c, "sample_id", "n")


# --- beads -----------------------------------------------------------------------------------------------------


@query(f"WITH {ITEMS_SQL}, s AS (SELECT sample_id, asinh(p / 5) AS x, row_number() OVER (PARTITION BY sample_id ORDER BY p) AS k, count(*) OVER (PARTITION BY sample_id) AS n, lead(asinh(p / 5)) OVER (PARTITION BY sample_id ORDER BY p) AS nx FROM ev), g AS (SELECT * FROM s WHERE k >= greatest(2, ceil(n * 0.05)) AND k <= n - greatest(1, ceil(n * 0.01)) AND nx > x) SELECT sample_id, round(5 * sinh(arg_min((x + nx) / 2, (-(nx - x), x))), 2) AS boundary FROM g GROUP BY sample_id")
def widest_gap(spark, d):
    return beads.widest_gap(items(spark, d), "sample_id", "p").select("sample_id", F.round("boundary", 2).alias("boundary"))


_WINDOW = "w0 AS (SELECT sample_id, max(p) AS high FROM ev GROUP BY 1), win AS (SELECT sample_id, 2 * quantile_cont(p, 0.5) - any_value(high) AS low, any_value(high) AS high FROM ev JOIN w0 USING (sample_id) WHERE p >= high / 2 GROUP BY sample_id)"


@query(f"WITH {ITEMS_SQL}, {_WINDOW} SELECT sample_id, round(low, 4) AS low, round(high, 4) AS high FROM win")
def bead_window(spark, d):
    return beads.isotope_window(items(spark, d), "sample_id", "p").select("sample_id", r4(F.col("low")).alias("low"), r4(F.col("high")).alias("high"))


def _bead_rows(spark, d) -> DataFrame:
    window = beads.isotope_window(items(spark, d), "sample_id", "p")
    rows = keyed_items(spark, d).join(window, "sample_id")
    inside = X.at_least(F.col("p"), F.col("low")) & X.at_most(F.col("p"), F.col("high")) & X.below(F.col("d"), 0.08)
    return rows.withColumns({"is_bead": inside, "is_removed": X.at_least(F.col("p"), F.col("low"))})


@query(f"WITH {ITEMS_SQL}, {_WINDOW} SELECT sample_id, CAST(sum(CASE WHEN p >= low AND p <= high AND d < 0.08 THEN 1 ELSE 0 END) AS BIGINT) AS beads, count(*) AS events FROM ev JOIN win USING (sample_id) GROUP BY 1")
def bead_gate(spark, d):
    return _bead_rows(spark, d).groupBy("sample_id").agg(F.sum(F.col("is_bead").cast("long")).alias("beads"), F.count(F.lit(1)).alias("events"))


@query(f"WITH {ITEMS_SQL}, {_WINDOW} SELECT sample_id, count(*) AS kept, round(sum(q), 2) AS total_q FROM ev JOIN win USING (sample_id) WHERE NOT p >= low GROUP BY 1")
def bead_removal_anti(spark, d):
    return _bead_rows(spark, d).filter(~F.col("is_removed")).groupBy("sample_id").agg(F.count(F.lit(1)).alias("kept"), F.round(F.sum("q"), 2).alias("total_q"))


_BINS = f"""i AS (SELECT sample_id, time, value, row_number() OVER (PARTITION BY sample_id ORDER BY time, event_id) - 1 AS k, count(*) OVER (PARTITION BY sample_id) AS n FROM ev),
z AS (SELECT *, ceil(n / least(200, least(greatest(2, CAST(round_even(n / 50.0, 0) AS BIGINT)), greatest(2, floor(n / 10))))) AS size FROM i WHERE n >= 20),
y AS (SELECT *, floor(k / size) AS b, floor((n - 1) / size) AS last FROM z),
x AS (SELECT *, CAST(CASE WHEN n - last * size < 25 AND last = 1 THEN CASE WHEN k >= n // 2 THEN 1 ELSE 0 END WHEN n - last * size < 25 AND last > 0 AND b = last THEN last - 1 ELSE b END AS INTEGER) AS bin FROM y),
tb AS (SELECT sample_id, bin, count(*) AS n, quantile_cont(time, 0.5) AS time, quantile_cont(value, 0.5) AS value FROM x GROUP BY sample_id, bin)"""


@query(f"WITH {TIMED_SQL}, {_BINS} SELECT sample_id, bin, n, round(time, 2) AS time, round(value, 4) AS value FROM tb")
def time_bins(spark, d):
    rows = beads.time_bins(timed(spark, d), "sample_id", "time", ["value"], ["event_id"])
    return rows.select("sample_id", "bin", "n", F.round("time", 2).alias("time"), r4(F.col("value")).alias("value"))


_ASOF = "kn AS (SELECT user_id % 7 AS g, floor(epoch_us(ts) / 1e6 / 86400) * 86400 AS kx, avg(value) AS ky FROM events GROUP BY ALL), sp AS (SELECT g, kx AS x0, ky AS y0, lead(kx) OVER (PARTITION BY g ORDER BY kx) AS x1, lead(ky) OVER (PARTITION BY g ORDER BY kx) AS y1 FROM kn), en AS (SELECT g, min(kx) AS lo, max(kx) AS hi, arg_min(ky, kx) AS ylo, arg_max(ky, kx) AS yhi FROM kn GROUP BY g), qv AS (SELECT event_id, user_id % 7 AS g, epoch_us(ts) / 1e6 AS time, value FROM events)"
_ASOF_VALUE = "CASE WHEN time <= lo THEN ylo WHEN time >= hi THEN yhi ELSE y0 + (time - x0) * (y1 - y0) / (x1 - x0) END"


def _knots(spark, d) -> DataFrame:
    raw = table(spark, d, "events").select("event_id", (F.col("user_id") % 7).alias("g"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("time"), "value")
    knots = raw.groupBy("g", (F.floor(F.col("time") / 86400) * 86400).alias("kx")).agg(F.avg("value").alias("ky"))
    return beads.asof_interpolate(raw, knots, ["g"], "time", "kx", "ky", "at")


@query(f"WITH {_ASOF} SELECT event_id, round({_ASOF_VALUE}, 4) AS at FROM qv JOIN en USING (g) LEFT JOIN sp ON sp.g = qv.g AND time >= x0 AND time < x1 AND time > lo AND time < hi")
def asof_interpolate(spark, d):
    """Daily means interpolated to the time of every event."""
    return _knots(spark, d).select("event_id", r4(F.col("at")).alias("at"))


@query(f"WITH {_ASOF} SELECT qv.g AS g, round(sum(value * 4000.0 / ({_ASOF_VALUE})), 2) AS total, count(*) AS n FROM qv JOIN en USING (g) LEFT JOIN sp ON sp.g = qv.g AND time >= x0 AND time < x1 AND time > lo AND time < hi GROUP BY 1")
def mass_normalize(spark, d):
    """Events times the drift factor reference / interpolated median."""
    return _knots(spark, d).groupBy("g").agg(F.round(F.sum(F.col("value") * 4000.0 / F.col("at")), 2).alias("total"), F.count(F.lit(1)).alias("n"))


_MASS_SQL = "regexp_matches(channel_name, '^(?:([A-Za-z]{1,2})([0-9]{2,3})|([0-9]{2,3})([A-Za-z]{1,2}))(?:[dD][iIdD])?$')"


@query(f"SELECT channel_name AS name, upper(e[1]) || lower(e[2:]) AS element, CAST(m AS INTEGER) AS mass FROM (SELECT DISTINCT channel_name, regexp_extract(channel_name, '([A-Za-z]{{1,2}})', 1) AS e, regexp_extract(channel_name, '([0-9]{{2,3}})', 1) AS m FROM channels WHERE {_MASS_SQL})")
def mass_parse(spark, d):
    names = table(spark, d, "channels").select(F.col("channel_name").alias("name")).filter("name IS NOT NULL").distinct()
    element, mass = beads.mass_of(F.col("name"))
    return names.select("name", element.alias("element"), mass.alias("mass")).filter("mass IS NOT NULL")


@query("WITH c AS (SELECT DISTINCT channel_name AS name, mass_number AS m, mass_element AS e FROM channels WHERE mass_number IS NOT NULL AND channel_kind = 'Mass'), p AS (SELECT a.name AS source, b.name AS receiver, 'abundance' AS r FROM c a JOIN c b ON abs(a.m - b.m) = 1 UNION ALL SELECT a.name, b.name, 'oxide' FROM c a JOIN c b ON b.m = a.m + 16 UNION ALL SELECT a.name, b.name, 'isotope' FROM c a JOIN c b ON a.e = b.e AND a.m <> b.m) SELECT source, receiver, string_agg(DISTINCT r, '+' ORDER BY r) AS reason FROM p WHERE source <> receiver GROUP BY ALL")
def leakage_pairs(spark, d):
    c = table(spark, d, "channels").filter("mass_number IS NOT NULL AND channel_kind = 'Mass'").select(F.col("channel_name").alias("name"), F.col("mass_number").alias("mass"), F.col("mass_element").alias("element")).distinct()
    return beads.leakage_pairs(c)


@query(f"WITH {ITEMS_SQL} SELECT sample_id, round(greatest(0, regr_slope(d, q)), 9) AS q_to_d, round(greatest(0, regr_slope(p, q)), 4) AS q_to_p FROM ev GROUP BY sample_id")
def mass_slopes(spark, d):
    slope = lambda y: F.greatest(F.lit(0.0), F.regr_slope(y, "q"))
    return items(spark, d).groupBy("sample_id").agg(F.round(slope("d"), 9).alias("q_to_d"), r4(slope("p")).alias("q_to_p"))


# --- spectra and neighbours ------------------------------------------------------------------------------------

_PEAK = 7
_E = f"ev AS (SELECT vec_id, label, CAST(embedding[{_PEAK + 1}] AS DOUBLE) AS v, embedding FROM embeddings), cut AS (SELECT quantile_cont(v, 0.99) AS c FROM ev WHERE label = 0)"


def _spectra(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding")[_PEAK].cast("double").alias("v"), "embedding")


@query(f"WITH {_E} SELECT label, count(*) AS n FROM ev, cut WHERE label <> 0 AND v > c GROUP BY label")
def positive_above_blank(spark, d):
    return platforms.above_blank(_spectra(spark, d), "label", 0, "v").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_E}, r AS (SELECT label, vec_id, v, row_number() OVER (PARTITION BY label ORDER BY v DESC, vec_id) AS k FROM ev WHERE label <> 0) SELECT label, vec_id, round(v, 6) AS v FROM r WHERE k <= 3000")
def topk_positive(spark, d):
    """The 3 000 brightest events of each stained control."""
    return platforms.brightest(_spectra(spark, d).filter("label <> 0"), "label", "v", "vec_id", spectra.POSITIVES).select("label", "vec_id", r6(F.col("v")).alias("v"))


_MEANS = "m AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS v FROM embeddings, range(1, 65) t(i) GROUP BY label, i)"


@query(f"WITH {_MEANS}, af AS (SELECT i, v FROM m WHERE label = 0), n AS (SELECT sum(v * v) AS q FROM af), dt AS (SELECT m.label, sum(m.v * af.v) AS dot FROM m JOIN af USING (i) GROUP BY 1), o AS (SELECT m.label, m.i, m.v - dot / q * af.v AS rest FROM m JOIN af USING (i) JOIN dt USING (label), n WHERE m.label <> 0) SELECT label, CAST(arg_min(i, (-rest, i)) - 1 AS INTEGER) AS peak FROM o GROUP BY label")
def spectral_peak(spark, d):
    """Detector with the largest mean once the blank's direction is taken out."""
    e = table(spark, d, "embeddings").select("label", "embedding")
    return spectra.peaks(e.filter("label <> 0"), e.filter("label = 0"), "label", "embedding")


@query("WITH m AS (SELECT label, i, greatest(0, quantile_cont(CAST(embedding[i] AS DOUBLE), 0.5)) AS v FROM embeddings, range(1, 65) t(i) GROUP BY label, i) SELECT label, CAST(i - 1 AS INTEGER) AS detector, round(v / max(v) OVER (PARTITION BY label), 6) AS signature FROM m")
def spectral_signature(spark, d):
    m = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("detector", "v"))
    m = stats.exact_medians(m, ["label", "detector"], ["v"]).withColumn("v", F.greatest(F.lit(0.0), F.col("v")))
    return m.select("label", "detector", r6(F.col("v") / F.max("v").over(Window.partitionBy("label"))).alias("signature"))


# --- tests -----------------------------------------------------------------------------------------------------


@query(f"WITH {ITEMS_SQL}, s AS (SELECT sample_id, count(*) AS n, avg(p) AS mean, quantile_cont(p, 0.5) AS median, exp(avg(ln(p))) AS geomean, var_samp(p) AS var FROM ev GROUP BY 1), r AS (SELECT * FROM s WHERE sample_id = 'A') SELECT s.sample_id, round(s.mean, 3) AS mean, round(s.median, 3) AS median, round(s.geomean, 3) AS geomean, round(s.mean / r.mean, 6) AS mean_fold, round(s.median / r.median, 6) AS median_fold, round(CASE WHEN s.sample_id = 'A' THEN NULL ELSE (s.mean - r.mean) / sqrt(s.var / s.n + r.var / r.n) END, 5) AS z FROM s, r")
def intensity_table(spark, d):
    """Means, folds over a reference sample and the z statistic of their difference."""
    v = stats.kept(F.col("p"))
    s = items(spark, d).groupBy("sample_id").agg(F.count(v).alias("n"), F.avg(v).alias("mean"), stats.geometric_mean(v).alias("geomean"), F.var_samp(v).alias("var"))
    s = s.join(stats.exact_medians(items(spark, d), ["sample_id"], ["p"]).withColumnRenamed("p", "median"), "sample_id")
    r = s.filter("sample_id = 'A'").first()
    z = (F.col("mean") - F.lit(r["mean"])) / F.sqrt(F.col("var") / F.col("n") + F.lit(r["var"] / r["n"]))
    return s.select("sample_id", F.round("mean", 3).alias("mean"), F.round("median", 3).alias("median"), F.round("geomean", 3).alias("geomean"), r6(F.col("mean") / r["mean"]).alias("mean_fold"), r6(F.col("median") / r["median"]).alias("median_fold"), F.round(F.when(F.col("sample_id") != "A", z), 5).alias("z"))


_RANKED = f"WITH {ITEMS_SQL}, c AS (SELECT p, sum(CASE WHEN sample_id = 'N' THEN 1 ELSE 0 END) AS a, sum(CASE WHEN sample_id = 'A' THEN 1 ELSE 0 END) AS b FROM ev WHERE sample_id IN ('N', 'A') GROUP BY p), r AS (SELECT *, sum(a) OVER (ORDER BY p) AS ua, sum(b) OVER (ORDER BY p) AS ub, sum(a) OVER () AS na, sum(b) OVER () AS nb FROM c)"


@query(_RANKED + " SELECT round(CAST(sum(a * (ub - b + b / 2.0)) AS DOUBLE), 1) AS u, CAST(any_value(na) AS BIGINT) AS n1, CAST(any_value(nb) AS BIGINT) AS n2 FROM r")
def mann_whitney_u(spark, d):
    t = compare.rank_statistics(items(spark, d), "sample_id", "p", "A").filter("sample_id = 'N'")
    return t.select(F.round("u", 1).alias("u"), F.col("n1").cast("long").alias("n1"), F.col("n2").cast("long").alias("n2"))


@query(_RANKED + " SELECT round(max(abs(ua / na - ub / nb)), 9) AS ks FROM r")
def ks_stat(spark, d):
    return compare.rank_statistics(items(spark, d), "sample_id", "p", "A").filter("sample_id = 'N'").select(F.round("ks", 9).alias("ks"))


@query(f"""WITH {ITEMS_SQL}, c AS (SELECT sample_id, p, count(*) AS a FROM ev GROUP BY ALL), v AS (SELECT DISTINCT p FROM c), g AS (SELECT DISTINCT sample_id FROM c WHERE sample_id <> 'A'),
r AS (SELECT g.sample_id, v.p, coalesce(x.a, 0) AS a, coalesce(y.a, 0) AS b FROM g CROSS JOIN v LEFT JOIN c x ON x.sample_id = g.sample_id AND x.p = v.p LEFT JOIN c y ON y.sample_id = 'A' AND y.p = v.p),
t AS (SELECT sample_id, sum(CAST(a + b AS DOUBLE) ** 3 - (a + b)) AS ties FROM r GROUP BY 1),
h AS (SELECT sample_id, CAST(least(floor((p - 900) / 109100.0 * 500), 499) AS INTEGER) AS b, CAST(count(*) AS DOUBLE) AS o FROM ev WHERE p >= 900 AND p <= 110000 GROUP BY ALL),
e AS (SELECT b, o AS e FROM h WHERE sample_id = 'A'), k AS (SELECT g.sample_id, coalesce(h.o, 0) AS o, coalesce(e.e, 0) + 1e-9 AS e FROM g CROSS JOIN range(500) n(i) LEFT JOIN h ON h.sample_id = g.sample_id AND h.b = n.i LEFT JOIN e ON e.b = n.i WHERE coalesce(h.o, 0) + coalesce(e.e, 0) > 0),
s AS (SELECT sample_id, greatest(sum(o), 1) AS so, greatest(sum(e), 1) AS se, count(*) AS kept FROM k GROUP BY 1),
x AS (SELECT sample_id, sum((o - e * so / se) * (o - e * so / se) / (e * so / se)) AS chi2, any_value(kept) - 1 AS dof FROM k JOIN s USING (sample_id) GROUP BY 1)
SELECT sample_id, round(ties, 1) AS ties, round(chi2, 2) AS chi2, CAST(dof AS INTEGER) AS dof FROM t JOIN x USING (sample_id)""")
def intensity_statistics(spark, d):
    """Tied ranks and the chi-square of 500 bins of every sample against a reference sample."""
    rows = items(spark, d)
    t = compare.rank_statistics(rows, "sample_id", "p", "A").join(compare.chi_square(rows, "sample_id", "p", "A", 900.0, 110000.0, 500), "sample_id")
    return t.select("sample_id", F.round("ties", 1).alias("ties"), F.round("chi2", 2).alias("chi2"), "dof")


@query(f"WITH {ITEMS_SQL}, g AS (SELECT sample_id, CAST(floor(q / 10) AS INTEGER) AS g, count(*) AS a FROM ev GROUP BY ALL) SELECT sample_id, round(sum(g * a) / sum(a), 6) AS division_index, round(sum(CASE WHEN g >= 1 THEN g * a END) / sum(CASE WHEN g >= 1 THEN a END), 6) AS proliferation_index, round(sum(a) / sum(a / pow(2, g)), 6) AS replication_index FROM g GROUP BY 1")
def division_indices(spark, d):
    g = items(spark, d).groupBy("sample_id", F.floor(F.col("q") / 10).cast("int").alias("g")).agg(F.count(F.lit(1)).alias("a"))
    later = F.col("g") >= 1
    return g.groupBy("sample_id").agg(r6(F.sum(F.col("g") * F.col("a")) / F.sum("a")).alias("division_index"), r6(F.sum(F.when(later, F.col("g") * F.col("a"))) / F.sum(F.when(later, F.col("a")))).alias("proliferation_index"), r6(F.sum("a") / F.sum(F.col("a") / F.pow(F.lit(2.0), F.col("g")))).alias("replication_index"))
