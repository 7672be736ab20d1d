"""Exact top-k search by inner product, with block-at-a-time pruning.

A vector's dimensions are its terms. Candidates lie in blocks of consecutive rows; for each block the greatest and least value of
every term are known, and their products with a query's terms, summed, bound the scores that the block can hold. Each
query takes its blocks by falling bound, scores them through the block's forward index (its rows as a matrix), and
ends as soon as the next bound falls below its k-th score.

Tiles of candidates and of queries meet by an equi-join on the tile pair; a tile holds a bounded number of rows, and a
pair's k best for each query are merged by a window over queries.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.session import materialize

K, BLOCK, CANDIDATE_TILE, QUERY_TILE = 5, 128, 8192, 4096


def _matrix(rows: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width))
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def search_tile(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int = K, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, id, score) of the k best rows of each query, rows with the query's own id left out; exact for integers.

    Rows must be in order of ids, so that of equal scores the first is the one to keep. Products are taken in doubles, which is exact
    while sums stay under 2**53; larger vectors are scored in Python's integers.
    """
    big = np.abs(queries).max(initial=0) * np.abs(rows).max(initial=0) * max(rows.shape[1], 1) >= 2**53
    n, n_blocks = len(queries), -(-len(rows) // block)
    starts = np.arange(n_blocks) * block
    high, low = np.maximum.reduceat(rows, starts, axis=0), np.minimum.reduceat(rows, starts, axis=0)
    bound = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
    if big:
        bound = bound * (1 + 1e-9 * np.sign(bound)) + 1  # rounded sums still bound
    order = np.argsort(-bound, axis=1, kind="stable")
    top_score = np.full((n, k), -np.inf, object if big else float)
    top_id = np.full((n, k), np.iinfo(np.int64).max)
    live = np.arange(n)
    for step in range(n_blocks):
        which = order[live, step]
        # A block whose bound equals the k-th score may still hold a smaller id.
        still = bound[live, which] >= top_score[live, -1].astype(float)
        live, which = live[still], which[still]
        if not len(live):
            break
        by_block = np.argsort(which, kind="stable")
        cuts = np.flatnonzero(np.r_[True, np.diff(which[by_block]) > 0, True])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            own = live[by_block[a:b]]
            s = starts[which[by_block[a]]]
            forward, forward_ids = rows[s : s + block], ids[s : s + block]
            if big:
                score = np.array([[sum(int(x) * int(y) for x, y in zip(q, r, strict=True)) for r in forward] for q in queries[own]], object)
            else:
                score = queries[own] @ forward.T
            score = np.where(forward_ids[None, :] == query_ids[own, None], -np.inf, score)
            if not big:
                hopeful = score.max(1) >= top_score[own, -1]
                own, score = own[hopeful], score[hopeful]
                if not len(own):
                    continue
                if score.shape[1] > 2 * k:  # the k best and all that tie with the k-th
                    kth = np.partition(score, -k, axis=1)[:, -k]
                    columns = np.flatnonzero((score >= kth[:, None]).any(0)) if len(own) < 8 else np.arange(score.shape[1])
                    score, forward_ids = score[:, columns], forward_ids[columns]
            both = np.concatenate([top_score[own], score], 1)
            both_ids = np.concatenate([top_id[own], np.broadcast_to(forward_ids, score.shape)], 1)
            if big:
                pick = np.array([sorted(range(both.shape[1]), key=lambda j: (-both[i, j], both_ids[i, j]))[:k] for i in range(len(own))])
            else:
                pick = np.lexsort((both_ids, -both), axis=1)[:, :k]
            top_score[own] = np.take_along_axis(both, pick, 1)
            top_id[own] = np.take_along_axis(both_ids, pick, 1)
    found = np.nonzero(top_score.astype(float) > -np.inf)
    limit = 2**63 - 1
    values = top_score[found]
    score = np.array([max(-limit, min(limit, int(v))) for v in values], np.int64) if big else values.astype(np.int64)
    return found[0], top_id[found], score


def top_k(vectors: DataFrame, is_query: F.Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of greatest integer inner product for each query row, equal scores by smaller id.

    Components become floor(scale * x). Vectors that are null or hold null or non-finite components, and rows with a null id, take no part. A
    shorter vector counts as filled up with zeros. Queries that are equal in id and vector are one query; a candidate with
    the query's id is left out; repeated candidates count each for itself. With fewer rows than k all are returned. Scores beyond 64 bits are clipped. Other
    columns are neither read nor returned; an empty table gives no rows.
    """
    v = F.col(vector_col)
    finite = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull()).where(F.coalesce(finite, F.lit(False)))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: x.cast("double")).alias("v"), is_query.alias("is_query"))
    rows = materialize(rows, "vectors")
    queries = rows.where("is_query").select("id", "v").distinct()
    n, n_queries = rows.count(), queries.count()
    candidate_tiles, query_tiles = max(1, -(-n // CANDIDATE_TILE)), max(1, -(-n_queries // QUERY_TILE))
    tile = lambda salt, tiles: F.pmod(F.xxhash64(F.lit(salt), "id", "v"), F.lit(tiles)).cast("int")
    left = rows.select("id", "v", tile(7, candidate_tiles).alias("c"), F.explode(F.sequence(F.lit(0), F.lit(query_tiles - 1))).alias("q"))
    right = queries.select("id", "v", F.explode(F.sequence(F.lit(0), F.lit(candidate_tiles - 1))).alias("c"), tile(6, query_tiles).alias("q"))

    def meet(candidates: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if candidates.empty or asked.empty:
            return pd.DataFrame({"query": [], "qv": [], "vec_id": [], "score": []})
        candidates = candidates.sort_values("id", kind="stable")
        width = max(candidates.v.map(len).max(), asked.v.map(len).max())
        whole = [np.floor(scale * _matrix(rows, width)) for rows in (asked.v, candidates.v)]
        at, ids, score = search_tile(whole[0], asked.id.to_numpy(), whole[1], candidates.id.to_numpy(), k)
        mark = np.array([hash(tuple(x)) for x in asked.v], np.int64)  # tells queries of one id apart
        return pd.DataFrame({"query": asked.id.to_numpy()[at], "qv": mark[at], "vec_id": ids, "score": score})

    found = left.groupBy("c", "q").cogroup(right.groupBy("c", "q")).applyInPandas(meet, "query long, qv long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query", "qv").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select(F.col("query").alias("query_id"), "rank", "vec_id", "score")
