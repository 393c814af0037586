"""Fits, neighbour graphs, integration and streaming counts."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytora.functions import exprs as X
from cytora.operators import compare, graph, hist, integrate, linalg, spectra
from cytora.operators.fits import curves, cutoffs, mixtures
from cytora.operators.fits.curves import Curve
from cytora.plans.adapters import items, timed
from cytora.plans.reference import QUERIES, query
from cytora.plans.reference_tables import survival
from cytora.session import table

r6 = lambda c: F.round(c, 6)

CURVES = {
    "g1": Curve("normal", {"amplitude": 2.0, "mean": 10.0, "sigma": 3.0}),
    "rise": Curve("linear", {"slope": 0.1, "intercept": 0.5}),
    "grow": Curve("exponential", {"rate": 0.05, "intercept": 0.1, "offset": 0.2}),
    "decay": Curve("gamma", {"shape": 2.5, "scale": 4.0, "amplitude": 3.0}),
    "density": Curve("gamma_density", {"shape": 2.5, "scale": 4.0}),
    "falling": Curve("log_logistic", {"slope": 4.0, "upper": 0.9, "midpoint": 20.0}),
    "drawn": Curve("hypergeometric", {"population": 60, "successes": 30, "draws": 25}),
    "s": Curve("polynomial", {"minimum": 5.0, "maximum": 40.0}, (0.1, 2.0, -2.5)),
    "fit": Curve("addition", {"intercept": 0.05}, (), (("g1", 1.0), ("s", 0.5))),
}
_T = "((q - 5.0) / 35.0)"
_CURVE_SQL = {
    "g1": "2.0 * exp(-0.5 * ((q - 10.0) / 3.0) * ((q - 10.0) / 3.0))",
    "rise": "0.1 * q + 0.5",
    "grow": "0.2 + exp(0.05 * q + 0.1)",
    "decay": f"CASE WHEN q > 0 THEN 3.0 * exp(1.5 * ln(q / 4.0) - q / 4.0 - {math.lgamma(2.5)!r} - ln(4.0)) ELSE 0 END",
    "density": f"CASE WHEN q > 0 THEN exp(1.5 * ln(q) - q / 4.0 - {math.lgamma(2.5)!r} - 2.5 * ln(4.0)) ELSE 0 END",
    "falling": "0.9 / (1 + exp(4.0 * (ln(q) - ln(20.0))))",
    "drawn": "CASE WHEN q <= 25 THEN exp(lgamma(31) - lgamma(q + 1) - lgamma(31 - q) + lgamma(31) - lgamma(26 - q) - lgamma(6 + q) - lgamma(61) + lgamma(26) + lgamma(36)) ELSE 'nan'::DOUBLE END",
    "s": f"CASE WHEN q >= 5 AND q <= 40 THEN greatest(0.1 + 2.0 * {_T} - 2.5 * {_T} * {_T}, 0) ELSE 0 END",
}
_CURVE_SQL["fit"] = f"0.05 + ({_CURVE_SQL['g1']}) + 0.5 * ({_CURVE_SQL['s']})"


@query("WITH x AS (SELECT DISTINCT l_quantity AS q FROM lineitem) SELECT q AS x, " + ", ".join(f"round({sql}, 6) AS {name}" for name, sql in _CURVE_SQL.items()) + " FROM x")
def curve_eval(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_quantity").alias("x")).distinct()
    return x.select("x", *[r6(curves.curve_column(n, CURVES, F.col("x"))).alias(n) for n in CURVES])


_NEAR = "WITH b AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings WHERE label = 0), p AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings WHERE label = 1), r AS (SELECT p.vec_id AS vec_id, b.vec_id AS blank, row_number() OVER (PARTITION BY p.vec_id ORDER BY (p.x - b.x) * (p.x - b.x) + (p.y - b.y) * (p.y - b.y), b.vec_id) AS k FROM p, b) SELECT vec_id, blank, CAST(k AS INTEGER) AS k FROM r WHERE k <= 2"


@query(_NEAR)
def knn2_blank(spark, d):
    """Two blank events nearest in scatter to each positive event."""
    e = table(spark, d, "embeddings").select("vec_id", "label", F.slice("embedding", 1, 2).alias("scatter"))
    near = spectra.nearest_blanks(e.filter("label = 1"), e.filter("label = 0"), "vec_id", "scatter", ["vec_id"])
    return near.select("vec_id", "blank", F.col("rank").alias("k"))


@query("WITH n AS (SELECT vec_id, embedding, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS norm FROM embeddings), r AS (SELECT a.vec_id, b.vec_id AS other, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / (a.norm * b.norm) DESC, b.vec_id) AS k FROM n a, n b WHERE a.vec_id <> b.vec_id) SELECT vec_id, other, CAST(k AS INTEGER) AS rank FROM r WHERE k <= 14")
def knn_graph(spark, d):
    g = graph.knn_graph(table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("x")), 15)
    return g.filter("rank > 0").select("vec_id", "other", F.col("rank").cast("int").alias("rank"))


_KNN = "n AS (SELECT vec_id, embedding, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS norm FROM embeddings), r AS (SELECT a.vec_id, b.vec_id AS other, 1 - list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / (a.norm * b.norm) AS d FROM n a, n b WHERE a.vec_id <> b.vec_id), e AS (SELECT *, d * d AS d2 FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, other) AS k FROM r) WHERE k <= 14)"


@query(f"WITH {_KNN}, w AS (SELECT vec_id, quantile_cont(d2, 0.5) AS s FROM e GROUP BY 1), x AS (SELECT least(e.vec_id, other) AS a, greatest(e.vec_id, other) AS b, sqrt(2 * sqrt(p.s * q.s) / greatest(p.s + q.s, 1e-300)) * exp(-d2 / greatest(p.s + q.s, 1e-300)) AS w FROM e JOIN w p ON p.vec_id = e.vec_id JOIN w q ON q.vec_id = other) SELECT a, b, round(max(w), 6) AS weight FROM x GROUP BY a, b")
def connectivities(spark, d):
    return _weights(spark, d).withColumn("weight", r6(F.col("weight")))


@query()
def fuzzy_union(spark, d):
    """Fuzzy union of the neighbourhoods of all vectors."""
    return graph.fuzzy_union(graph.knn_graph(table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("x")), 15), 15)


def _weights(spark, d) -> DataFrame:
    g = graph.knn_graph(table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("x")), 15)
    return graph.connectivities(g)


@query()
def clustering(spark, d):
    """Communities of the neighbour graph by power iteration, a substitute."""
    return graph.power_clusters(_weights(spark, d), 4)


@query()
def pca_embedding(spark, d):
    """Two principal components of the vectors, a substitute for a neighbour-preserving layout."""
    return graph.principal_components(table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("x")), 64)


@query()
def cutoff_fit(spark, d):
    """Index cutoff of every sample from its survival curve."""
    s = survival(items(spark, d), "sample_id", "p")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("point")
        found = cutoffs.index_cutoff(pdf["x"].to_numpy(), pdf["share"].to_numpy())
        return pd.DataFrame({"sample_id": [pdf["sample_id"].iloc[0]], "cutoff": [math.nan if found is None else found]})

    return s.groupBy("sample_id").applyInPandas(fit, "sample_id string, cutoff double")


@query()
def cytonorm_apply(spark, d):
    """Mean and spread of two channels after batch integration."""
    rows = integrate.integrated(items(spark, d).select("batch", "q", "p"), "batch", ["q", "p"])
    return rows.groupBy("batch").agg(*[r6(f(F.col(c).cast("double"))).alias(f"{n}_{c}") for c in ("q", "p") for n, f in (("mean", F.avg), ("sd", F.stddev_samp))])


@query()
def unmix_fit(spark, d):
    """Unmixing coefficients of every molecule, from the signatures of all labels."""
    s = QUERIES["spectral_signature"](spark, d).toPandas()
    wide = s.pivot(index="label", columns="detector", values="signature").sort_index()
    m = linalg.unmixing_matrix(wide.to_numpy())
    rows = [(int(label), int(j), float(m[i, j])) for i, label in enumerate(wide.index) for j in range(m.shape[1])]
    return spark.createDataFrame(rows, "label int, detector int, coefficient double")


def _histograms(spark, d, bins: int) -> DataFrame:
    x = X.arcsinh(F.col("value") / 5.0)
    rows = timed(spark, d).select("sample_id", x.alias("x"))
    ends = rows.agg(F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    lo, hi = ends["lo"], ends["hi"] if ends["hi"] > ends["lo"] else ends["lo"] + 1
    counted = hist.counted(rows, ["sample_id"], F.least(F.floor((F.col("x") - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("int"))
    return hist.dense(counted, ["sample_id"], bins).withColumn("x", F.lit(lo) + (F.col("bin") + 0.5) * ((hi - lo) / bins))


@query()
def cell_cycle(spark, d):
    """Phases of every sample's histogram under both models."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")
        n = pdf["n"].sum()
        rows = []
        for model in ("watson", "dean") if n >= 20 else ():
            y = curves.smooth(pdf["n"].to_numpy(float) / n, 2)
            rows.append({"sample_id": pdf["sample_id"].iloc[0], "model": model, "events": int(n)} | mixtures.cell_cycle(pdf["x"].to_numpy(), y, model))
        return pd.DataFrame(rows, columns=["sample_id", "model", "events", "g1", "s", "g2", "g1_mean", "g1_cv", "g2_mean", "g2_cv", "ratio"])

    return _histograms(spark, d, 400).groupBy("sample_id").applyInPandas(fit, "sample_id string, model string, events long, g1 double, s double, g2 double, g1_mean double, g1_cv double, g2_mean double, g2_cv double, ratio double")


@query()
def proliferation(spark, d):
    """Generations of every sample's histogram."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")
        n = pdf["n"].sum()
        if n < 20:
            return pd.DataFrame(columns=["sample_id", "generation", "fraction", "mean", "division", "proliferation", "replication"])
        f = mixtures.proliferation(curves.smooth(pdf["n"].to_numpy(float) / n, 3))
        k = np.flatnonzero(f["fractions"] >= 0.001)
        return pd.DataFrame({"sample_id": pdf["sample_id"].iloc[0], "generation": k, "fraction": f["fractions"][k], "mean": f["means"][k], "division": f["division"], "proliferation": f["proliferation"], "replication": f["replication"]})

    return _histograms(spark, d, 500).groupBy("sample_id").applyInPandas(fit, "sample_id string, generation int, fraction double, mean double, division double, proliferation double, replication double")


@query()
def intensity_tests(spark, d):
    """Probabilities of the two-sample tests of every sample against sample A, from sums, rank counts and histograms."""
    return compare.intensity_tests(items(spark, d), "sample_id", "p", "A", 900.0, 110000.0)


@query("SELECT event_type AS sample_id, count(*) AS n_events, sum(CASE WHEN CAST(value AS FLOAT) >= 100 THEN 1 ELSE 0 END)::BIGINT AS n_high FROM events GROUP BY 1")
def stream_counts(spark, d):
    """Population counts over the event stream, run to its end; an extension."""
    from cytora.streaming import counts

    return counts.run_to_end(spark, d)



