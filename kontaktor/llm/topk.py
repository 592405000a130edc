"""Exact top-k search by inner product with multi-resolution segment statistics.

Each vector is cut in 1, 2, 4, ... segments whose means and deviations bound its
inner products: over a segment, <q, x> <= length * (mean_q * mean_x + dev_q * dev_x).
Candidates that a coarse bound leaves meet the next finer one; survivors get
their exact score. All numbers are integers, so scores and ties are exact.

Candidates lie in blocks of bounded size, alike ones together. A block's envelope (least
and greatest means, greatest deviations) bounds all of its rows at once. Each query
first meets the block whose bound is best; its k-th score there tells which other
blocks can hold better ones, and only these it meets. No vector is shipped to a
block of queries that its envelope rules out, and no task holds more than two blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, table, written

K = 5
QUERY_BLOCK, CANDIDATE_BLOCK = 1024, 16384
MOST_BLOCKS = 65_536  # beyond so many, blocks grow; every worker has the envelopes of all
LEVELS = (1, 4, 16)  # segments
CELLS = 8  # segments whose means' signs tell which vectors are alike


def statistics(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums, root of the squared deviations' sum, and lengths of the segments of each row."""
    cuts = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)[:-1]
    sizes = np.diff(np.append(cuts, x.shape[1])).astype(float)
    total = np.add.reduceat(x, cuts, axis=1)
    squares = np.add.reduceat(x * x, cuts, axis=1)
    return total, np.sqrt(np.maximum(squares - total * total / sizes, 0)), sizes


def search(queries: np.ndarray, query_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, floors: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """(query id, id, score) of each query's k best rows of x, its own id apart; ties to the smaller id. Scores under a query's
    floor aren't wanted."""
    out: list[tuple[int, int, int]] = []
    if not len(queries) or not len(x):
        return out
    order = np.argsort(ids, kind="stable")
    x, ids = x[order], ids[order]
    levels = [n for n in LEVELS if n <= x.shape[1]] or [1]
    of_x = [statistics(x, n) for n in levels]
    weighted = [np.concatenate([s / np.sqrt(z), d], axis=1) for s, d, z in of_x]
    of_q = [np.concatenate([s / np.sqrt(z), d], axis=1) for s, d, z in (statistics(queries, n) for n in levels)]
    slack = 1e-6 * (1 + np.abs(x).max() * np.abs(queries).max() * x.shape[1])
    coarse = of_q[0] @ weighted[0].T
    for i, q in enumerate(queries):
        others = ids != query_ids[i]
        bound = np.where(others, coarse[i], -np.inf)
        n = int(others.sum())
        if not n:
            continue
        # Exact scores of the most promising rows give the threshold that every later bound must reach.
        first = np.argpartition(-bound, min(4 * k, n) - 1)[: min(4 * k, n)]
        scores = x[first] @ q
        least = np.partition(scores, -min(k, n))[-min(k, n)]
        if floors is not None:
            least = max(least, floors[i])
        live = np.flatnonzero(bound >= least - slack)
        for fine, own in zip(weighted[1:], of_q[1:], strict=True):
            if len(live) <= 4 * k:
                break
            live = live[fine[live] @ own[i] >= least - slack]
        scores = x[live] @ q
        best = np.lexsort((ids[live], -scores))[:k]
        out += [(int(query_ids[i]), int(ids[live[b]]), int(scores[b])) for b in best]
    return out


def weighted(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of segments, weighted so that the bound is the sum of their products."""
    total, deviation, sizes = statistics(x, segments)
    return total / np.sqrt(sizes), deviation


def envelope(x: np.ndarray) -> list[np.ndarray]:
    """Least and greatest means and greatest deviations of a block's rows."""
    mean, deviation = weighted(x, LEVELS[-1])
    return [mean.min(axis=0), mean.max(axis=0), deviation.max(axis=0)]


def block_bounds(queries: np.ndarray, envelopes: np.ndarray) -> np.ndarray:
    """What no row of each block can surpass with each query. envelopes: a row for each block."""
    mean, deviation = weighted(queries, LEVELS[-1])
    return np.concatenate([np.minimum(mean, 0), np.maximum(mean, 0), deviation], axis=1) @ envelopes.T


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = pa.chunked_array(column.chunks if isinstance(column, pa.ChunkedArray) else [column]).combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _by_dim(batch) -> dict[int, np.ndarray]:
    dims = batch.column("dim").to_numpy()
    return {int(d): np.flatnonzero(dims == d) for d in np.unique(dims)}


def top_k(vectors: DataFrame, *, k: int = K, id_col: str = "vec_id", column: str = "embedding", every: int = 50, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id `every` divides, the k rows of the highest integer inner product.

    Components are floor(scale * x). Vectors that are null or hold a null, NaN or infinite component take no part, nor
    do rows without an id. Vectors of another length than a query's don't meet it. Repeated ids: each row is a candidate
    of its own; the greatest vector is the query, which never meets rows of its own id. An empty table gives no rows."""
    spark = vectors.sparkSession
    fine = F.forall(column, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(column).isNotNull() & (F.size(column) > 0) & fine)
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(column, lambda v: F.floor(v.cast("double") * scale).cast("double")).alias("v"), F.size(column).alias("dim"))

    def cells(batches):
        for b in batches:
            cell, norm = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows)
            for _, own in _by_dim(b).items():
                x = _matrix(b.column("v").take(pa.array(own)))
                signs = weighted(x, CELLS)[0] > 0
                cell[own] = signs @ (1 << np.arange(signs.shape[1]))
                norm[own] = np.sqrt((x * x).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(norm)], [*b.schema.names, "cell", "norm"])

    rows = written(rows.mapInArrow(cells, "vec_id long, v array<double>, dim int, cell long, norm double"))
    n = rows.count()
    blocks = max(1, -(-n // max(CANDIDATE_BLOCK, -(-n // MOST_BLOCKS))))
    ordered = rows.withColumn("r", F.monotonically_increasing_id()).repartitionByRange(blocks, "dim", "cell", "norm", "vec_id", "r")
    dealt = written(ordered.select("vec_id", "v", "dim", F.spark_partition_id().alias("block")))
    discard(rows)

    def enveloped(own: pa.Table) -> pa.Table:
        parts = envelope(_matrix(own.column("v")))
        return pa.table({"block": own.column("block")[:1], "dim": own.column("dim")[:1], "e": pa.array([np.concatenate(parts)], pa.list_(pa.float64()))})

    # A row for each block: MOST_BLOCKS of them at most.
    made = dealt.groupBy("block", "dim").applyInArrow(enveloped, "block int, dim int, e array<double>").toArrow()
    of_dim = {d: (made.column("block").take(pa.array(own)).to_numpy(), _matrix(made.column("e").take(pa.array(own)))) for d, own in _by_dim(made).items()}
    envelopes = spark.sparkContext.broadcast(of_dim)
    queries = written(dealt.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.max(F.struct("v", "dim")).alias("x")).select("vec_id", "x.*", F.lit(float("-inf")).alias("floor"), F.lit(-1).alias("first")))

    def to_blocks(only_best: bool):
        def run(batches):
            for b in batches:
                at, to = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                floor, first = b.column("floor").to_numpy(), b.column("first").to_numpy()
                for d, own in _by_dim(b).items():
                    ids, e = envelopes.value[d]
                    x = _matrix(b.column("v").take(pa.array(own)))
                    for i in range(0, len(own), 256):
                        part, q = own[i : i + 256], x[i : i + 256]
                        bounds = block_bounds(q, e)
                        if only_best:
                            at.append(part)
                            to.append(ids[bounds.argmax(axis=1)])
                        else:
                            # Sums of rounding errors are far below a part in a million of what can be summed.
                            slack = 1e-6 * (1 + np.abs(bounds).max(axis=1))
                            i_q, i_b = np.nonzero((bounds >= (floor[part] - slack)[:, None]) & (ids[None, :] != first[part][:, None]))
                            at.append(part[i_q])
                            to.append(ids[i_b])
                found, block = b.take(pa.array(np.concatenate(at))), np.concatenate(to)
                yield pa.RecordBatch.from_arrays([*(found.column(c) for c in ("vec_id", "v", "dim", "floor")), pa.array(block, pa.int32())], ["vec_id", "v", "dim", "floor", "block"])

        return run

    def meet(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int, int]] = []
        for dim, own in q.groupby("dim"):
            others = c[c["dim"] == dim]
            if len(others):
                found += search(np.stack(own["v"].to_list()), own["vec_id"].to_numpy(), np.stack(others["v"].to_list()), others["vec_id"].to_numpy(), k, own["floor"].to_numpy())
        return pd.DataFrame([(*x, int(c["block"].iloc[0])) for x in found], columns=["query_id", "vec_id", "score", "block"])

    def met(asked: DataFrame) -> DataFrame:
        """asked queries (with block) and the rows of their blocks. A block that many ask is there once for each QUERY_BLOCK of them."""
        crowd = asked.groupBy("block").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("parts"))
        crowd = F.broadcast(crowd)  # MOST_BLOCKS rows at most
        q = asked.join(crowd, "block").select("block", F.pmod(F.xxhash64("vec_id"), "parts").cast("int").alias("part"), "vec_id", "v", "dim", "floor")
        c = dealt.join(crowd, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "vec_id", "v", "dim")
        return q.groupBy("block", "part").cogroup(c.groupBy("block", "part")).applyInPandas(meet, "query_id long, vec_id long, score long, block int")

    asked = "vec_id long, v array<double>, dim int, floor double, block int"
    best = written(queries.mapInArrow(to_blocks(True), asked))
    near = written(met(best))
    # The k-th score of a query's first block, if it has so many, is a floor for all others.
    floors = near.groupBy("query_id").agg(F.sort_array(F.collect_list(F.col("score").cast("double")), asc=False).alias("s"))
    floors = floors.select(F.col("query_id").alias("vec_id"), F.coalesce(F.get("s", F.lit(k - 1)), F.lit(float("-inf"))).alias("floor"))
    again = best.select("vec_id", "v", "dim", F.col("block").alias("first")).join(floors, "vec_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    rest = written(again.mapInArrow(to_blocks(False), asked))
    all_met = near.unionByName(met(rest)).drop("block")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return all_met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


QUERIES = {"op7_topk": op7_topk}
ORACLES = {
    "op7_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""
}
