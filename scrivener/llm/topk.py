"""Exact top-k inner products: vectors in order of length, partial sums in SVD-rotated coordinates, Cauchy-Schwarz pruning.

Vectors stand in blocks of similar length. The block of the longest vectors gives every query a first k-th score; a block
whose longest vector cannot reach it for any query of a query block is never sent there. Inside a pair of blocks, vectors
go by descending length until the product of lengths falls below the k-th score; the others are scored on the leading
rotated coordinates plus the product of the residual lengths, an upper bound, and exactly only where that can still count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Vectors of a block, queries of a block, levels of length, rotated coordinates that are summed first, vectors a step.
BLOCK, QUERIES, LEVELS, LEADING, STRIDE = 2048, 1024, 64, 16, 512
#: Up to this bound of a score floating-point products of integers are exact; a score that a long can't hold is given as its limit.
EXACT, LIMIT = float(1 << 53), (1 << 63) - 1


def _rotation(vectors: DataFrame) -> dict[int, np.ndarray]:
    """By dimension: right singular vectors of all vectors, from sums of products (dimension squared numbers a dimension)."""

    def gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for dim, rows in b.groupby("dim")["x"]:
                if dim:
                    m = np.stack(rows.to_numpy()).astype(float)
                    total[dim] = total.get(dim, 0) + m.T @ m
        for dim, g in total.items():
            yield pd.DataFrame({"dim": dim, "at": np.arange(dim * dim), "v": g.ravel()})

    sums = vectors.select("dim", "x").mapInPandas(gram, "dim int, at int, v double").groupBy("dim", "at").agg(F.sum("v").alias("v")).toPandas()
    return {int(dim): np.linalg.eigh(g.sort_values("at")["v"].to_numpy().reshape(int(dim), int(dim)))[1][:, ::-1] for dim, g in sums.groupby("dim")}


def _best(queries: np.ndarray, own: np.ndarray, floor: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, rotation: np.ndarray | None) -> list[list[tuple[int, int]]]:
    """(id, score) of each query's best k among the vectors with a score of at least floor."""
    scores, names = np.full((len(queries), k), -np.inf), np.full((len(queries), k), np.iinfo(np.int64).max)
    q, v = queries.astype(float), vectors.astype(float)
    length_q, length_v = np.linalg.norm(q, axis=1), np.linalg.norm(v, axis=1)
    if length_q.max(initial=0) * length_v.max(initial=0) >= EXACT:
        return _best_of_large(queries, own, vectors, ids, k)
    order = np.lexsort((ids, -length_v))
    v, vectors, ids, length_v = v[order], vectors[order], ids[order], length_v[order]
    if rotation is not None:
        rq, rv = q @ rotation, v @ rotation
        p = min(LEADING, q.shape[1])
        tail_q, tail_v = np.linalg.norm(rq[:, p:], axis=1), np.linalg.norm(rv[:, p:], axis=1)
    floor = floor.copy()
    for at in range(0, len(v), STRIDE):
        part = slice(at, at + STRIDE)
        slack = 1e-9 * length_q * length_v[at] + 1e-6  # rounding never prunes
        live = np.flatnonzero(length_q * length_v[at] + slack >= floor)
        if not len(live):
            break
        may = own[live, None] != ids[None, part]
        if rotation is not None:
            bound = rq[live, :p] @ rv[part, :p].T + tail_q[live, None] * tail_v[None, part]
            may &= bound + slack[live, None] >= floor[live, None]
        hit = may.any(1)
        live, may = live[hit], may[hit]
        columns = np.flatnonzero(may.any(0))
        if not len(live) or not len(columns):
            continue
        dots = q[live] @ v[part][columns].T
        new = np.where(may[:, columns] & (dots >= floor[live, None]), dots, -np.inf)
        both = np.concatenate([scores[live], new], axis=1)
        which = np.concatenate([names[live], np.where(new > -np.inf, ids[part][columns][None], np.iinfo(np.int64).max)], axis=1)
        top = np.lexsort((which, -both), axis=1)[:, :k]
        scores[live], names[live] = np.take_along_axis(both, top, 1), np.take_along_axis(which, top, 1)
        floor[live] = np.maximum(floor[live], scores[live, -1])
    found = scores > -np.inf
    return [[(int(i), int(s)) for i, s in zip(names[j][found[j]], scores[j][found[j]], strict=True)] for j in range(len(q))]


def _best_of_large(queries: np.ndarray, own: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
    """The same for scores that floating point can't hold: in whole numbers of any size, ranked before they are limited to a long."""
    out, columns = [], vectors.astype(object)
    for q, name in zip(queries.astype(object), own, strict=True):
        best = sorted((-int(s), int(i)) for s, i in zip(columns @ q if len(q) else [0] * len(ids), ids, strict=True) if i != name)[:k]
        out.append([(i, max(-LIMIT - 1, min(LIMIT, -s))) for s, i in best])
    return out


def _cells(cells: DataFrame, k: int, rotations: dict[int, np.ndarray]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matrix = lambda rows: np.stack([np.asarray(r, np.int64) for r in rows]).reshape(len(rows), -1)
        for b in batches:
            for r in b.itertuples():
                q, v = matrix(r.q_x), matrix(r.v_x)
                own = np.asarray(r.q_ids)
                best = _best(q, own, np.asarray(r.q_floor, float), v, np.asarray(r.v_ids), k, rotations.get(q.shape[1]))
                rows = [(int(i), *pair) for i, pairs in zip(own, best, strict=True) for pair in pairs]
                yield pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype(np.int64)

    return cells.mapInPandas(run, "query_id long, vec_id long, score long")


def top_inner_products(vectors: DataFrame, is_query, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row for each query and rank: query_id, rank (from 1), vec_id, score.

    Components become floor(scale * x); the score is the integer inner product with every vector of the same dimension but
    those of the query's own id; ties go to the smaller id. Vectors that are null, or hold a null or a component that is
    not finite, and rows without an id take no part. Ids are integers. An empty table, or one without queries, gives an empty
    result. Of rows that repeat an id and a vector one counts. The same path runs at every size.
    """
    x = F.col(vector_col)
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    ints = F.transform(x, lambda v: F.floor(v.cast("double") * scale))
    v = vectors.filter(F.col(id_col).isNotNull() & x.isNotNull() & F.coalesce(whole, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), ints.alias("x"), is_query.alias("is_query"))
    v = v.withColumns({"dim": F.size("x"), "length": F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, c: a + c.cast("double") * c))}).distinct()
    v = materialize(v, "vectors")
    counted = v.agg(F.count("*"), F.count(F.when(F.col("is_query"), 1)), F.percentile_approx("length", [i / LEVELS for i in range(1, LEVELS)], 10_000)).first()
    if not counted[0]:
        return v.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # blocks: level 0 holds the longest; levels with many equal lengths have more blocks, dealt by a hash
    cuts = sorted(set(counted[2]), reverse=True)
    level = F.lit(len(cuts))
    for n, c in reversed(list(enumerate(cuts))):
        level = F.when(F.col("length") >= c, n).otherwise(level)
    v = v.withColumn("level", level)
    sizes = {r["level"]: math.ceil(r["count"] / BLOCK) for r in v.groupBy("level").count().collect()}  # at most LEVELS rows
    parts = F.element_at(F.create_map(*[F.lit(z) for pair in sizes.items() for z in pair]), F.col("level"))
    deal = F.xxhash64("id", "x")
    packed = lambda prefix: [F.transform("all", lambda s: s["id"]).alias(f"{prefix}_ids"), F.transform("all", lambda s: s["x"]).alias(f"{prefix}_x")]
    blocks = v.withColumn("part", F.pmod(deal, parts)).groupBy("dim", "level", "part").agg(F.collect_list(F.struct("id", "x")).alias("all"), F.max("length").alias("longest"))
    blocks = materialize(blocks.select(F.monotonically_increasing_id().alias("block"), "dim", "level", "longest", *packed("v")), "blocks")
    many = max(1, math.ceil(counted[1] / QUERIES))
    asked = v.filter("is_query").withColumn("q_block", F.pmod(deal, F.lit(many)).cast("int")).groupBy("dim", "q_block")
    asked = materialize(asked.agg(F.collect_list(F.struct("id", "x")).alias("all")).select("dim", "q_block", *packed("q")), "queries")
    rotations = _rotation(v)
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(many - 1))).alias("q_block")  # the set of queries, block by block, against all blocks
    none = F.transform("q_ids", lambda _: F.lit(float("-inf"))).alias("q_floor")
    first = asked.select("*", none).join(blocks.filter("level = 0").select("*", everywhere), ["dim", "q_block"])
    seeds = materialize(_cells(first.select("q_ids", "q_x", "q_floor", "v_ids", "v_x"), k, rotations), "seeds")
    by_score = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    kth = seeds.withColumn("r", F.row_number().over(by_score)).filter(F.col("r") == k).select("query_id", F.col("score").cast("double").alias("floor"))
    # the k-th scores, in the order of the block's queries
    lines = asked.select("dim", "q_block", F.posexplode(F.arrays_zip("q_ids", "q_x")).alias("at", "q")).select("dim", "q_block", "at", F.col("q.q_ids").alias("query_id"), F.col("q.q_x").alias("x"))
    lines = lines.join(kth, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    length = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, c: a + c.cast("double") * c))
    floors = lines.groupBy("dim", "q_block").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "floor"))), lambda s: s["floor"]).alias("q_floor"),
        F.min(F.when((length > 0) & (F.col("floor") > 0), F.col("floor") / length).otherwise(F.lit(0.0))).alias("least"),
    )
    asked = materialize(asked.join(floors, ["dim", "q_block"]), "floors")
    # which block may reach which queries is settled on the lengths alone; vectors are copied only to where they may count
    reach = blocks.filter("level > 0").select("block", "dim", "longest", everywhere).join(asked.select("dim", "q_block", "least"), ["dim", "q_block"])
    reach = materialize(reach.filter(F.col("longest") * (1 + 1e-9) + 1e-6 >= F.col("least")).select("block", "dim", "q_block"), "reach")
    pairs = reach.join(blocks.select("block", "v_ids", "v_x"), "block").join(asked.drop("least"), ["dim", "q_block"])
    seeds = seeds.unionByName(_cells(pairs.select("q_ids", "q_x", "q_floor", "v_ids", "v_x"), k, rotations))
    ranked = seeds.distinct().withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
