"""Exact top-k search: term-at-a-time accumulation over blocks of candidates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RESULT = "query_id long, vec_id long, score long"


def sparse_rows(df: DataFrame, id_col: str, vector_col: str, scale: int = 256) -> DataFrame:
    """Rows (id, terms, weights): the nonzero components of floor(scale * x), x as double.

    Null vectors and vectors holding a null, NaN or infinite component are left out; an empty vector has no terms.
    """
    x = F.col(vector_col)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    whole = F.transform(x, lambda v: F.floor(v.cast("double") * scale))
    pairs = F.filter(F.transform(whole, lambda v, i: F.struct(i.alias("t"), v.alias("w"))), lambda p: p["w"] != 0)
    return (
        df.filter(x.isNotNull() & F.col(id_col).isNotNull() & ~bad)
        .select(F.col(id_col).cast("long").alias("id"), pairs.alias("p"))
        .select("id", F.col("p.t").alias("terms"), F.col("p.w").alias("weights"))
    )


def postings(table: pa.Table) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """The ids of a block in ascending order, and for each term the row numbers and weights that have it."""
    ids = table["id"].to_numpy()
    terms, weights = table["terms"].combine_chunks(), table["weights"].combine_chunks()
    lengths = np.diff(terms.offsets.to_numpy())
    order = np.argsort(ids, kind="stable")
    rank = np.empty(len(ids), dtype=np.int64)
    rank[order] = np.arange(len(ids))
    row = np.repeat(rank, lengths)
    flat_t, flat_w = terms.flatten().to_numpy(), weights.flatten().to_numpy().astype(np.int64)
    by_term = np.lexsort((row, flat_t))
    row, flat_t, flat_w = row[by_term], flat_t[by_term], flat_w[by_term]
    cuts = np.flatnonzero(np.diff(flat_t)) + 1
    starts = np.r_[0, cuts] if len(flat_t) else []
    ends = np.r_[cuts, len(flat_t)] if len(flat_t) else []
    return ids[order], {int(flat_t[a]): (row[a:b], flat_w[a:b]) for a, b in zip(starts, ends)}


def accumulate(queries: pa.Table, candidates: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Dense scores: each query's term scatters its weight times the term's postings into the query's row."""
    q_ids, q_lists = postings(queries)
    c_ids, c_lists = postings(candidates)
    scores = np.zeros((len(q_ids), len(c_ids)), dtype=np.int64)
    for term, (q_rows, q_weights) in q_lists.items():
        if term not in c_lists:
            continue
        c_rows, c_weights = c_lists[term]
        full = len(c_rows) == len(c_ids)
        for q, w in zip(q_rows, q_weights):
            if full:
                scores[q] += w * c_weights
            else:
                scores[q, c_rows] += w * c_weights
    return q_ids, c_ids, scores


def select(q_ids: np.ndarray, c_ids: np.ndarray, scores: np.ndarray, k: int) -> pa.Table:
    """The k best of each row by partition selection, ties to the smaller id; a query never finds its own id."""
    out_q, out_c, out_s = [], [], []
    for q, row in zip(q_ids, scores):
        others = np.flatnonzero(c_ids != q)
        values = row[others]
        if len(values) > k:
            floor = np.partition(values, len(values) - k)[len(values) - k]
            above, level = np.flatnonzero(values > floor), np.flatnonzero(values == floor)
            pick = np.r_[above, level[: k - len(above)]]
        else:
            pick = np.arange(len(values))
        out_q.append(np.full(len(pick), q))
        out_c.append(c_ids[others[pick]])
        out_s.append(values[pick])
    empty = np.empty(0, dtype=np.int64)
    return pa.table({
        "query_id": np.concatenate(out_q or [empty]), "vec_id": np.concatenate(out_c or [empty]), "score": np.concatenate(out_s or [empty]),
    })


def exact_top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, query_block: int = 512, block: int = 8192) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` best integer inner products over all candidates.

    ``queries`` and ``candidates`` are rows (id, terms, weights). Both are dealt by a hash of the id into blocks of
    about ``query_block`` and ``block`` rows; each pair of blocks is one group holding a dense score array of at most
    their product, and keeps ``k`` rows a query. Work is queries × candidates, which is the question asked; what is
    copied is each block once for every block of the other side. Ties go to the smaller id; a query with fewer
    candidates returns all; empty inputs return nothing. Repeated ids are separate rows with the same id.
    """
    n_q, n_c = queries.count(), candidates.count()
    q_blocks, c_blocks = max(1, -(-n_q // query_block)), max(1, -(-n_c // block))
    deal = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    left = queries.withColumn("qb", deal(q_blocks)).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1))))
    right = candidates.withColumn("cb", deal(c_blocks)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))

    def search(q: pa.Table, c: pa.Table) -> pa.Table:
        if not q.num_rows or not c.num_rows:
            return select(np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, 0), np.int64), k)
        return select(*accumulate(q, c), k)

    found = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInArrow(search, RESULT)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
