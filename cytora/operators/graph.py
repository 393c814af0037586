"""Neighbour graphs, exact at any size (large vector sets are compared block against block); weights and substitutes.

Community detection and layout of the kind that needs libraries not at hand are replaced by power iteration
clustering and principal components, named as such.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cytora.session import hashed, materialise

#: Vectors up to which all of them are shared with every task; beyond that, vectors of a block.
EXACT_ROWS = 8192


def _rows(pdf: pd.DataFrame, metric: str) -> np.ndarray:
    x = np.stack([np.asarray(v, dtype=np.float64) for v in pdf["x"]]) if len(pdf) else np.zeros((0, 1))
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) if metric == "cosine" else x


def _nearest(q: np.ndarray, qid: np.ndarray, x: np.ndarray, xid: np.ndarray, k: int, metric: str) -> pd.DataFrame:
    """(vec_id, other, distance) of the k nearest; the vector itself counts as its own first neighbour."""
    out = []
    for a in range(0, len(q), 512):
        part = q[a : a + 512]
        d = 1 - part @ x.T if metric == "cosine" else np.maximum((part**2).sum(1)[:, None] + (x**2).sum(1)[None, :] - 2 * part @ x.T, 0)
        d[qid[a : a + 512, None] == xid[None, :]] = -1.0
        best = np.argpartition(d, min(k, len(x)) - 1, axis=1)[:, :k]
        for i in range(len(part)):
            order = best[i][np.lexsort((xid[best[i]], d[i, best[i]]))]
            out.append(pd.DataFrame({"vec_id": qid[a + i], "other": xid[order], "distance": d[i, order]}))
    found = pd.concat(out) if out else pd.DataFrame({"vec_id": [], "other": [], "distance": []})
    found["distance"] = np.maximum(found["distance"], 0)
    return found if metric == "cosine" else found.assign(distance=np.sqrt(found["distance"]))


_SCHEMA = "vec_id long, other long, distance double"


def knn_graph(vectors: DataFrame, k: int = 15, metric: str = "cosine", exact_rows: int = EXACT_ROWS) -> DataFrame:
    """(vec_id, other, distance, rank) with rank 0 for the vector itself.

    Every vector is compared with all: up to ``exact_rows`` vectors, that bounded set is shared with all tasks; beyond, each
    block of queries meets each block of members in a task of its own and the k nearest of all blocks are kept, so the result
    is the same. The cost grows with the square of the number of vectors. Null vectors are left out.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("x")).filter("vec_id IS NOT NULL AND x IS NOT NULL").dropDuplicates(["vec_id"])
    total = rows.count()
    if total <= exact_rows:
        side = rows.toPandas()
        shared = rows.sparkSession.sparkContext.broadcast((_rows(side, metric), side["vec_id"].to_numpy()))

        def all_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            x, xid = shared.value
            for pdf in batches:
                if len(pdf):
                    yield _nearest(_rows(pdf, metric), pdf["vec_id"].to_numpy(), x, xid, k, metric)

        pairs = rows.mapInPandas(all_of, _SCHEMA)
    else:
        blocks = -(-total // exact_rows)
        home = materialise(rows.withColumn("x", F.col("x").cast("array<double>")).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")))
        other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))

        def meet(pdf: pd.DataFrame) -> pd.DataFrame:
            queries, members = pdf[~pdf["member"]], pdf[pdf["member"]]
            if queries.empty or members.empty:
                return pd.DataFrame({"vec_id": [], "other": [], "distance": []})
            return _nearest(_rows(queries, metric), queries["vec_id"].to_numpy(), _rows(members, metric), members["vec_id"].to_numpy(), k, metric)

        asked = home.select("vec_id", "x", F.lit(False).alias("member"), F.col("block").alias("q"), other.alias("m"))
        met = home.select("vec_id", "x", F.lit(True).alias("member"), other.alias("q"), F.col("block").alias("m"))
        pairs = hashed(asked.unionByName(met), "q", "m").groupBy("q", "m").applyInPandas(meet, _SCHEMA)
    w = Window.partitionBy("vec_id").orderBy(F.when(F.col("vec_id") == F.col("other"), -1.0).otherwise(F.col("distance")), "other")
    return pairs.withColumn("rank", F.row_number().over(w) - 1).filter(F.col("rank") < k)


def connectivities(graph: DataFrame) -> DataFrame:
    """(a, b, weight), a < b: Gaussian weights with each vector's own width (median of squared distances), both directions averaged."""
    edges = graph.filter("vec_id != other").select("vec_id", "other", (F.col("distance") * F.col("distance")).alias("d2"))
    width = edges.groupBy("vec_id").agg(F.percentile("d2", F.lit(0.5)).alias("s"))  # k values at most
    one = edges.join(width, "vec_id").withColumnRenamed("s", "s1")
    both = one.join(width.select(F.col("vec_id").alias("other"), F.col("s").alias("s2")), "other")
    total = F.greatest(F.col("s1") + F.col("s2"), F.lit(1e-300))
    weight = F.sqrt(2 * F.sqrt(F.col("s1") * F.col("s2")) / total) * F.exp(-F.col("d2") / total)
    return both.select(F.least("vec_id", "other").alias("a"), F.greatest("vec_id", "other").alias("b"), weight.alias("w")).groupBy("a", "b").agg(F.max("w").alias("weight"))


def fuzzy_union(graph: DataFrame, k: int) -> DataFrame:
    """(a, b, weight), a < b: fuzzy union of neighbourhoods (McInnes, Healy and Melville, 2018).

    A neighbour belongs to a vector's neighbourhood by ``exp(-(d - nearest) / width)``, with a width at which memberships add up to the
    logarithm of ``k``; a pair belongs together by ``u + v - u v`` of its two memberships.
    """
    lists = graph.filter("vec_id != other").groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct("distance", "other"))).alias("n"))  # k entries at most
    rows = lists.select("vec_id", F.transform("n", lambda s: s["distance"]).alias("d"), F.transform("n", lambda s: s["other"]).alias("o"))

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            n = pdf["d"].map(len).to_numpy()
            d = np.full((len(pdf), n.max()), np.inf)
            for i, v in enumerate(pdf["d"]):
                d[i, : len(v)] = v
            positive = np.where(d > 0, d, np.inf).min(axis=1)
            over = np.maximum(d - np.where(np.isfinite(positive), positive, 0)[:, None], 0)
            low, high = np.full(len(pdf), 1e-12), np.full(len(pdf), 1e6)
            for _ in range(80):  # halving on a logarithmic scale, all vectors at once
                middle = np.sqrt(low * high)
                more = np.exp(-over / middle[:, None]).sum(axis=1) > np.log2(k)
                high, low = np.where(more, middle, high), np.where(more, low, middle)
            width = np.maximum(np.sqrt(low * high), 1e-3 * np.where(np.isfinite(d), d, 0).sum(axis=1) / n)
            weight = np.exp(-over / np.maximum(width, 1e-12)[:, None])
            at = np.repeat(np.arange(len(pdf)), n)
            yield pd.DataFrame({"vec_id": pdf["vec_id"].to_numpy()[at], "other": np.concatenate(pdf["o"].to_list()), "w": weight[at, np.concatenate([np.arange(m) for m in n])]})

    each = rows.mapInPandas(members, "vec_id long, other long, w double").select(F.least("vec_id", "other").alias("a"), F.greatest("vec_id", "other").alias("b"), "w")
    # of one or two memberships: their sum less their product
    return each.groupBy("a", "b").agg((1 - F.exp(F.sum(F.ln(F.greatest(1 - F.col("w"), F.lit(1e-300)))))).alias("weight"))


def power_clusters(weights: DataFrame, k: int, iterations: int = 20) -> DataFrame:
    """(vec_id, cluster): power iteration clustering of the weighted graph, a substitute for modularity communities."""
    from pyspark.ml.clustering import PowerIterationClustering

    pic = PowerIterationClustering(k=k, maxIter=iterations, srcCol="a", dstCol="b", weightCol="weight", initMode="degree")
    return pic.assignClusters(weights.select("a", "b", "weight")).select(F.col("id").alias("vec_id"), F.col("cluster").cast("int").alias("cluster"))


def principal_components(vectors: DataFrame, dims: int, k: int = 2) -> DataFrame:
    """(vec_id, c1, c2, ...): projections on the first components, a substitute for a neighbour-preserving layout.

    Sums and products of the tasks are added up by Spark, place by place; only ``dims`` squared numbers reach the driver.
    """
    rows = vectors.filter("x IS NOT NULL").filter(F.size("x") == dims)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, q = 0, np.zeros(dims), np.zeros((dims, dims))
        for pdf in batches:
            if len(pdf):
                x = _rows(pdf, "as is")
                n, s, q = n + len(x), s + x.sum(0), q + x.T @ x
        flat = np.concatenate([[n], s, q.ravel()])
        yield pd.DataFrame({"place": np.arange(len(flat)), "v": flat})

    parts = rows.select("x").mapInPandas(sums, "place int, v double").groupBy("place").agg(F.sum("v").alias("v")).orderBy("place").toPandas()
    flat = parts["v"].to_numpy() if len(parts) else np.zeros(1 + dims + dims * dims)
    n = int(flat[0])
    mean = flat[1 : 1 + dims] / max(n, 1)
    cov = flat[1 + dims :].reshape(dims, dims) / max(n, 1) - np.outer(mean, mean)
    values, axes = np.linalg.eigh(cov)
    axes = axes[:, np.argsort(-values)[:k]]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
    columns = []
    for j in range(axes.shape[1]):
        w = F.array(*[F.lit(float(v)) for v in axes[:, j]])
        dot = F.aggregate(F.zip_with("x", w, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, v: s + v)
        columns.append((dot - float(mean @ axes[:, j])).alias(f"c{j + 1}"))
    return rows.select("vec_id", *columns)
