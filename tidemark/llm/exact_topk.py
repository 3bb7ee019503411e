"""Exact top-k by integer inner product over an impact-ordered index, score at a time.

Vectors are dealt into blocks of bounded size. In a block, the index has for each dimension posting segments
of equal quantised value: the vectors whose component lies between the segment's least and most. For a
query, a segment's impact is the most it can add: the product with the query's component, over the least
that the dimension can add. Segments of all dimensions are processed by descending impact, in rounds that
each reach a given share of them. A processed posting adds its segment's least and most to its vector's bounds; what
is not processed can add no more than the impact that comes next. A query stops only when the bounds prove
that few vectors can be among its best k, or after the last segment; those vectors are scored exactly.

Queries go to the blocks in parts, as one row each, and a bounded number of parts meets a block as one group. The two
are grouped together instead of joined: Spark would take the copies of the queries for as small as the queries and
broadcast them. A vector has one posting per dimension, so the postings of a block are kept as a table of segment
numbers, and the bounds after a round are sums of what it looks up there, for all queries of a part at once.

Defined results: vectors that are NULL or hold NULL or non-finite components, and rows without an id, take no
part; every row is a candidate, so rows equal in id and vector stand in the ranks as often as they occur; rows
of one id ask as one query, with the best rows of either vector, and are its own; only vectors of the query's dimension are candidates, and queries of no dimension have
none; sums are 64-bit; ties go to the smaller id; an empty table gives an empty result; columns that are
not named stay unread.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import settle

#: Vectors in a block and queries in a part, on average.
BLOCK, QUERIES = 4096, 64
#: Parts that meet a block at a time, and the most partitions that these groups are dealt over.
PARTS, PARTITIONS = 128, 4096
#: Posting segments of a dimension.
SEGMENTS = 32
#: Share of the segments processed after each round, and the share of a block that may be scored exactly.
ROUNDS, RESCORED = (1 / 3, 1), 16
#: Whole numbers up to these sizes are exact as floats and as doubles.
_SINGLE, _EXACT = 1 << 24, 1 << 52
_EMPTY = np.int64(1 << 62)


def integers(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component as a double; NULL if the vector takes no part."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    good = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(good, F.transform(doubles, lambda x: F.floor(F.lit(scale) * x)))


def _packed(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    part = part.sort_values("id", kind="stable")
    return part["id"].to_numpy(np.int64), np.array(part["vector"].tolist(), np.int64)


def _index(part: pd.DataFrame) -> pd.DataFrame:
    """The rows of one block -> its index, one row: ids, vectors, each component's segment, and the segments'
    least and most values."""
    ids, rows = _packed(part)
    low, high = rows.min(axis=0), rows.max(axis=0)
    segment = ((rows - low) // ((high - low) // SEGMENTS + 1)).astype(np.uint8)
    least, most = np.full((rows.shape[1], SEGMENTS), _EMPTY), np.full((rows.shape[1], SEGMENTS), -_EMPTY)
    dims = np.broadcast_to(np.arange(rows.shape[1]), rows.shape)
    np.minimum.at(least, (dims, segment), rows)
    np.maximum.at(most, (dims, segment), rows)
    return pd.DataFrame({
        "block": [part["block"].iloc[0]], "width": [rows.shape[1]], "ids": [ids.tobytes()],
        "times": [part.sort_values("id", kind="stable")["times"].to_numpy(np.int64).tobytes()], "rows": [rows.tobytes()],
        "segment": [segment.tobytes()], "least": [least.tobytes()], "most": [most.tobytes()],
    })


def _queries(part: pd.DataFrame) -> pd.DataFrame:
    ids, rows = _packed(part)
    return pd.DataFrame({"group": [part["part"].iloc[0] // PARTS], "width": [rows.shape[1]], "query_ids": [ids.tobytes()], "query_rows": [rows.tobytes()]})


class BlockIndex:
    """The index of one block, as a task sees it."""

    def __init__(self, width: int, ids: bytes, times: bytes, rows: bytes, segment: bytes, least: bytes, most: bytes) -> None:
        self.ids, self.times = np.frombuffer(ids, np.int64), np.frombuffer(times, np.int64)
        self.rows = np.frombuffer(rows, np.int64).reshape(len(self.ids), width)
        self.segment = np.frombuffer(segment, np.uint8).reshape(len(self.ids), width)
        self.least, self.most = (np.frombuffer(x, np.int64).reshape(width, SEGMENTS) for x in (least, most))
        self.filled, self.postings = self.least <= self.most, np.ascontiguousarray(self.segment.T.astype(np.intp))

    def possible(self, queries: np.ndarray, k: int) -> np.ndarray:
        """For each query the vectors that may be among its best k; all others are proved not to be."""
        n, width = self.rows.shape
        large = float(np.abs(queries).max()) * float(max(np.abs(self.rows).max(), 1)) * width * 4
        if k >= n or large >= _EXACT:
            return np.ones((len(queries), n), bool)
        kind = np.float32 if large < _SINGLE else np.float64
        least, most = (np.where(self.filled, x, 0)[:, :, None] * queries.T[:, None, :] for x in (self.least, self.most))
        down, up, filled = np.minimum(least, most), np.maximum(least, most), self.filled[:, :, None]
        floor = np.where(filled, down, _EMPTY).min(axis=1, keepdims=True)  # least that a dimension adds
        gain, impact = (np.where(filled, x - floor, 0).astype(kind) for x in (down, up))
        descending = -np.sort(-impact.reshape(-1, len(queries)), axis=0)
        may, unproved = np.ones((len(queries), n), bool), np.arange(len(queries))
        for share in ROUNDS:
            done = impact >= descending[int(len(descending) * share) - 1]
            ahead = np.where(done, 0, impact).max(axis=(0, 1))  # the impact that comes next
            low, high = self._bounds(np.where(done, gain, 0), np.where(done, impact, ahead))
            may[unproved] = high >= np.partition(low, n - k, axis=1)[:, n - k, None]
            rest = np.count_nonzero(may[unproved], axis=1) > max(k, n // RESCORED)
            if not rest.any():
                break
            unproved, gain, impact, descending = unproved[rest], gain[:, :, rest], impact[:, :, rest], descending[:, rest]
        return may

    def _bounds(self, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What each query's segments add up to at least and at most, per query and vector."""
        sums, added = np.zeros((len(self.ids), 2 * least.shape[2]), least.dtype), np.concatenate([least, most], axis=2)
        for dimension, segments in enumerate(self.postings):
            sums += added[dimension].take(segments, axis=0)
        low, high = np.split(np.ascontiguousarray(sums.T), 2)
        return low, high

    def best(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each query the ids, times and scores of the best k, in order; rows with its own id do not count."""
        own = np.searchsorted(self.ids, query_ids, "right") - np.searchsorted(self.ids, query_ids, "left")
        found = []
        for query_id, query, may in zip(query_ids, queries, self.possible(queries, k + int(own.max()))):
            rows = np.flatnonzero(may & (self.ids != query_id))
            scores = self.rows[rows] @ query
            first = np.lexsort((self.ids[rows], -scores))[:k]
            found.append((self.ids[rows[first]], self.times[rows[first]], scores[first]))
        return found


def top_k(vectors: DataFrame, is_query: Column, k: int, id_column: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id and score: the best k candidates of every row where ``is_query`` holds."""
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), integers(F.col(vector), scale).alias("vector"), is_query.alias("asks"))
    good = rows.where("id IS NOT NULL AND vector IS NOT NULL AND size(vector) > 0")
    rows = settle(good.groupBy("id", "vector").agg(F.max("asks").alias("asks"), F.count(F.lit(1)).alias("times")), "vectors")
    blocks = max(1, -(-rows.count() // BLOCK))
    asking = max(1, -(-rows.where("asks").count() // QUERIES))
    width, near = F.size("vector").alias("width"), F.xxhash64("id", "vector")
    index = rows.select("id", "vector", "times", width, F.pmod(near, F.lit(blocks)).alias("block")).groupBy("block", "width").applyInPandas(
        _index, "block bigint, width int, ids binary, times binary, rows binary, segment binary, least binary, most binary")
    asked = rows.where("asks").select("id", "vector", width, F.pmod(near, F.lit(asking)).alias("part")).groupBy("part", "width").applyInPandas(
        _queries, "group bigint, width int, query_ids binary, query_rows binary")
    groups, by = -(-asking // PARTS), ("block", "width", "group")
    index = index.withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    # Twice as many partitions as groups, so that few have to take two.
    dealt = [df.repartition(min(2 * blocks * groups, PARTITIONS), *by).groupBy(*by) for df in (index, asked)]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        for own in left.itertuples() if len(right) else ():
            block = BlockIndex(own.width, own.ids, own.times, own.rows, own.segment, own.least, own.most)
            for part in right.itertuples():
                asking_ids = np.frombuffer(part.query_ids, np.int64)
                asking_rows = np.frombuffer(part.query_rows, np.int64).reshape(len(asking_ids), part.width)
                for query_id, best in zip(asking_ids, block.best(asking_ids, asking_rows, k)):
                    found.append((np.full(len(best[0]), query_id), *best))
        columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * 4
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "times", "score"), columns)))

    # A query has at most k rows from each block, of different vectors. Equal rows were indexed once.
    hits = dealt[0].cogroup(dealt[1]).applyInPandas(run, "query_id bigint, vec_id bigint, times bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank")
    hits = best.select("query_id", "vec_id", "score", F.explode(F.sequence(F.lit(1).cast("long"), F.least("times", F.lit(k).cast("long")))))
    return hits.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
