"""Exact top-k by inner product with vector-approximation files (Weber, Schek and Blott 1998)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, mapped
from .vectors import blocks_of, matrix, usable

#: Cells of a dimension, and rows and queries of a block.
CELLS, ROWS, QUERIES = 16, 8192, 4096


def approximate(x: np.ndarray, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cell of each component, and each cell's least and greatest value: codes (n x d), low and high (d x cells)."""
    cuts = np.quantile(x, np.linspace(0, 1, cells + 1)[1:-1], axis=0)
    codes = np.stack([np.searchsorted(cuts[:, d], x[:, d]) for d in range(x.shape[1])], axis=1).astype(np.uint8)
    low, high = np.full((x.shape[1], cells), np.inf), np.full((x.shape[1], cells), -np.inf)
    for d in range(x.shape[1]):
        np.minimum.at(low[d], codes[:, d], x[:, d])
        np.maximum.at(high[d], codes[:, d], x[:, d])
    return codes, low, high


def search(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query, id, score) of each query's k best rows of one block, ties to the smaller id; more where ids repeat at the end are cut by id.

    The scan of the cells gives each row a bound of its distance from above and from below; exact rows are read from the best bound on,
    until the k-th best score lies above all bounds that are left.
    """
    codes, low, high = approximate(x)
    at = np.arange(x.shape[1])
    least, most = low[at, codes], high[at, codes]
    out = []
    for first in range(0, len(queries), 256):
        q = queries[first : first + 256]
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        bound = up @ most.T + down @ least.T
        for own, query, above in zip(query_ids[first : first + 256], q, bound, strict=True):
            above[ids == own] = -np.inf
            size, got, scores = 4 * k, np.empty(0, np.int64), np.empty(0)
            while True:
                size = min(size, len(ids))
                near = np.argpartition(-above, size - 1)[:size] if size < len(ids) else np.arange(len(ids))
                near = near[above[near] > -np.inf]
                got, scores = near, x[near] @ query
                rest = np.delete(above, near).max(initial=-np.inf)
                if size == len(ids) or (len(near) >= k and np.partition(scores, -k)[-k] > rest):
                    break
                size *= 4
            best = np.lexsort((ids[got], -scores))[:k]
            out += [(int(own), int(ids[got[b]]), int(scores[b])) for b in best]
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score: for each query row the k rows of another id with the greatest inner product of floor(scale * x).

    vectors: vec_id, embedding. Vectors that are null, empty, or hold null or non-finite components, and rows with a null id, take no part;
    vectors of different lengths are not compared. Ties go to the smaller vec_id. A repeated row is a candidate of its own; a query asked
    by several rows of one id is asked once, with the first by a hash. All rows meet all queries in blocks: each task holds one block of
    each, and returns k rows for a query at most.
    """
    whole = vectors.where(usable() & F.col("vec_id").isNotNull()).select("vec_id", F.col("embedding").alias("x"), F.size("embedding").alias("d"))
    whole = kept(whole.withColumn("h", F.xxhash64("vec_id", "x")))
    asked = whole.where(is_query).groupBy("vec_id", "d").agg(F.min_by("x", "h").alias("x"), F.min("h").alias("h"))
    asked = kept(asked)
    rows, queries = blocks_of(whole, ROWS), blocks_of(asked, QUERIES)
    deal = lambda df, own, n, other, m: df.withColumn(own, F.pmod("h", F.lit(n))).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1)))).select("d", F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), "vec_id", "x")

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            x, q = np.floor(scale * matrix(left["x"])), np.floor(scale * matrix(right["x"]))
            found = search(left["vec_id"].to_numpy(), x, right["vec_id"].to_numpy(), q, k)
        columns = list(zip(*found, strict=True)) or [[], [], []]
        return pa.table({n: pa.array(v, pa.int64()) for n, v in zip(("query_id", "vec_id", "score"), columns, strict=True)})

    keys = ["d", "r", "c"]
    mapped(whole, lambda b: b, whole.schema.simpleString()[7:-1].replace(":", " "))  # sends the package
    found = deal(whole, "r", rows, "c", queries).groupBy(*keys).cogroup(deal(asked, "c", queries, "r", rows).groupBy(*keys)).applyInArrow(one, "query_id long, vec_id long, score long")
    place = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
