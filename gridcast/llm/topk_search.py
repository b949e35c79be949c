"""Exact top-k inner-product search with a KD-tree per shard.

Vectors are dealt into cells by the upper levels of a KD-tree, whose split values are fitted on a
bounded sample (every vector is dealt, whatever the sample), and large cells into shards of bounded
size, so that a value which very many rows share spreads too. In a shard, median splits lead to
leaves; every node has the tight box of its rows. A query is first searched in its own shard. The
kth score found there goes with it to the other shards, whose cells' boxes could hold an equal or
better score; there the tree is walked best box first, and ends at boxes below the kth score.

Queries meet shards in blocks: a task holds one shard and one block of the queries that ask it, never
all of either. A shard is copied once per such block, so not at all where nothing asks it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridcast.llm.common import materialize
from gridcast.llm.registry import register, table

SCALE = 256
#: Rows of a shard, of a leaf, and queries of a block.
SHARD_ROWS = 16_384
LEAF_ROWS = 128
BLOCK_QUERIES = 20_000
#: Most cells, and rows of the sample that their splits are fitted on.
MAX_CELLS = 1024
SAMPLE_ROWS = 8192


def _exact(vectors: np.ndarray) -> np.ndarray:
    """The same whole numbers in the fastest type in which their inner products are exact."""
    if not vectors.size:
        return vectors.astype(np.float64)
    most = max(abs(int(vectors.max())), abs(int(vectors.min())), 1)
    products = most * most * vectors.shape[1]
    return vectors.astype(np.float64 if products < 1 << 53 else np.int64 if products < 1 << 63 else object)


class Tree:
    """KD-tree over the rows of a shard: median splits along the widest side, tight boxes."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, leaf: int = LEAF_ROWS):
        order = np.arange(len(ids))
        self.low, self.high, self.children, self.span = [], [], [], []
        todo = [(0, len(ids), -1, 0)]
        while todo:
            start, end, parent, side = todo.pop()
            rows = vectors[order[start:end]]
            low, high = rows.min(axis=0), rows.max(axis=0)
            node = len(self.span)
            self.low.append(low)
            self.high.append(high)
            self.span.append((start, end))
            self.children.append([-1, -1])
            if parent >= 0:
                self.children[parent][side] = node
            widest = int(np.argmax(high - low))
            if end - start > leaf and high[widest] > low[widest]:
                middle = (end - start) // 2
                order[start:end] = order[start:end][np.argpartition(rows[:, widest], middle)]
                todo.append((start, start + middle, node, 0))
                todo.append((start + middle, end, node, 1))
        self.vectors, self.ids = vectors[order], ids[order]
        self.low, self.high = np.array(self.low), np.array(self.high)

    def search(self, query: np.ndarray, own: int, k: int, kth: int | None) -> list[tuple[int, int]]:
        """Up to k pairs (-score, id), best first, of scores not below `kth`; rows with id `own` are left out."""
        bounds = box_bounds(self.low, self.high, query)
        floor = -np.inf if kth is None else kth
        best: list[tuple[int, int]] = []
        queue = [(-bounds[0], 0)]
        while queue and -queue[0][0] >= floor:  # an equal score may still win by its smaller id
            _, node = heapq.heappop(queue)
            left, right = self.children[node]
            if left >= 0:
                heapq.heappush(queue, (-bounds[left], left))
                heapq.heappush(queue, (-bounds[right], right))
                continue
            start, end = self.span[node]
            scores = self.vectors[start:end] @ query
            hits = np.flatnonzero((scores >= floor) & (self.ids[start:end] != own))
            if len(hits):
                best += zip((-scores[hits]).tolist(), self.ids[start:end][hits].tolist(), strict=True)
                best = sorted(best)[:k]
                if len(best) == k:
                    floor = max(floor, -best[-1][0])
        return [(int(score), int(i)) for score, i in best]


def in_blocks(asked: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with `block`: a shard's queries in as many blocks as their number needs, its rows once for each."""
    sizes = asked.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).cast("int").alias("_blocks"))
    own = asked.join(sizes, "shard").withColumn("block", F.pmod(F.xxhash64("row"), F.col("_blocks")).cast("int"))
    copies = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    return own.drop("_blocks"), held.join(sizes, "shard").withColumn("block", copies).drop("_blocks")


def box_bounds(low: np.ndarray, high: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Largest inner product that any vector of each box can have with the query."""
    zero = query * 0
    return high @ np.maximum(query, zero) + low @ np.minimum(query, zero)


class Cells:
    """Upper levels of a KD-tree over all vectors of one dimension: splits as (axis, value), heap order."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.levels = max(0, (cells - 1).bit_length()) if len(sample) else 0
        self.axis = np.zeros(1 << self.levels, np.int64)
        self.value = np.zeros(1 << self.levels, np.int64)
        parts = {1: sample}
        for node in range(1, 1 << self.levels):
            own = parts.pop(node)
            if len(own):
                axis = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
                self.axis[node], self.value[node] = axis, int(np.median(own[:, axis]))
            right = own[:, self.axis[node]] > self.value[node]
            parts[2 * node], parts[2 * node + 1] = own[~right], own[right]

    def of(self, vectors: np.ndarray) -> np.ndarray:
        node = np.ones(len(vectors), np.int64)
        for _ in range(self.levels):
            node = 2 * node + (vectors[np.arange(len(vectors)), self.axis[node]] > self.value[node])
        return node


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.int64).reshape(len(column), -1)


def quantised(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """vec_id, dim, v (array of floor(256 x)); rows with a null or empty vector or a component that is null or not finite are left out."""
    usable = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    return rows.where((F.size(vector) > 0) & usable & F.col(vec_id).isNotNull()).select(
        F.col(vec_id).cast("long").alias("vec_id"), F.size(vector).alias("dim"), whole.alias("v")
    )


def top_k(
    rows: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k rows of highest inner product, ties to the smaller id.

    `is_query` is a condition over vec_id. Candidates of a query are all rows of its dimension but
    those with its id. Fewer than k rows come where there are fewer candidates. Rows with a null or
    not finite vector or component, or a null id, take no part. Rows that repeat a query's id are
    queries of their own; equal candidates are listed as often as they come. Empty in, empty out.
    """
    spark = rows.sparkSession
    all_rows = materialize(quantised(rows, vec_id, vector).withColumn("row", F.monotonically_increasing_id()), "vectors")

    # Cells, fitted per dimension on a bounded sample; salts by the measured size of each cell.
    # Few more rows than the sample's pass the draw, however many there are, so a task sorts few of them.
    total = all_rows.count()
    drawn = F.pmod(F.xxhash64("vec_id", "row"), F.lit(1 << 40))
    candidate_rows = all_rows.where(drawn < int((1 << 40) * min(1.0, 2 * SAMPLE_ROWS / max(1, total))))
    sample = candidate_rows.orderBy(drawn, "row").limit(SAMPLE_ROWS).select("dim", "v").toPandas()
    wanted = max(1, min(MAX_CELLS, -(-total // SHARD_ROWS)))
    fitted = {int(d): Cells(_matrix(part["v"]), wanted) for d, part in sample.groupby("dim") if d}
    cells = spark.sparkContext.broadcast(fitted)

    def assign(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for dim, own in part.groupby("dim"):
                known = cells.value.get(int(dim))
                yield own.assign(cell=known.of(_matrix(own["v"])) if known else 1)

    dealt = materialize(all_rows.mapInPandas(assign, "vec_id long, dim int, v array<long>, row long, cell long"), "dealt")
    sizes = dealt.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n")).withColumn("salts", F.ceil(F.col("n") / SHARD_ROWS))
    sizes = materialize(sizes, "sizes")
    salt = F.pmod(F.xxhash64("vec_id", "row"), F.col("salts"))
    shard = F.concat_ws(":", "dim", "cell", salt)
    placed = materialize(dealt.join(F.broadcast(sizes.drop("n")), ["dim", "cell"]).withColumn("shard", shard), "placed")

    # Boxes of the cells: at most MAX_CELLS per dimension, whatever the number of rows.
    def boxes(part: pd.DataFrame) -> pd.DataFrame:
        v = _matrix(part["v"])
        return pd.DataFrame(
            {"dim": part["dim"].iloc[:1], "cell": part["cell"].iloc[:1], "low": [v.min(axis=0)], "high": [v.max(axis=0)]}
        )

    def joined(part: pd.DataFrame) -> pd.DataFrame:
        low, high = _matrix(part["low"]).min(axis=0), _matrix(part["high"]).max(axis=0)
        return pd.DataFrame({"dim": part["dim"].iloc[:1], "cell": part["cell"].iloc[:1], "low": [low], "high": [high]})

    shape = "dim int, cell long, low array<long>, high array<long>"
    found = placed.groupBy("shard").applyInPandas(boxes, shape).groupBy("dim", "cell").applyInPandas(joined, shape)
    known_boxes = {}
    for row in found.toPandas().itertuples(index=False):  # one row per cell
        known_boxes.setdefault(int(row.dim), []).append((int(row.cell), np.asarray(row.low), np.asarray(row.high)))
    salts = {(r["dim"], r["cell"]): r["salts"] for r in sizes.collect()}  # one row per cell
    shared = spark.sparkContext.broadcast((known_boxes, salts))

    queries = placed.where(is_query)
    asked = queries.select(F.col("vec_id").alias("query_id"), "row", "dim", "v", "shard", "cell")
    home = materialize(asked.withColumn("kth", F.lit(None).cast("long")).drop("dim", "cell"), "asked")

    def search(own: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(own) and len(held):
            both = _exact(np.concatenate([_matrix(held["v"]), _matrix(own["v"])]))
            tree = Tree(both[: len(held)], held["vec_id"].to_numpy())
            rest = zip(own["query_id"], own["row"], own["kth"], both[len(held) :], strict=True)
            for query_id, row, kth, vector in rest:
                best = tree.search(vector, query_id, k, None if pd.isna(kth) else int(kth))
                out += [(query_id, row, i, -score) for score, i in best]
        return pd.DataFrame(out, columns=["query_id", "row", "vec_id", "score"])

    def searched(asked: DataFrame) -> DataFrame:
        """Results of queries in the shards they ask; `asked` is a written table."""
        own, held = in_blocks(asked, placed.select("shard", "vec_id", "v"))
        groups = own.groupBy("shard", "block").cogroup(held.groupBy("shard", "block"))
        return groups.applyInPandas(search, "query_id long, row long, vec_id long, score long")

    near = materialize(searched(home), "home")

    def elsewhere(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, salts = shared.value
        stacked = {}
        for dim, own in known.items():
            cell, low, high = zip(*own, strict=True)
            stacked[dim] = (cell, np.array(low).astype(object), np.array(high).astype(object))
            if max(abs(int(x)) for x in (np.min(low), np.max(high))) < 1 << 22:
                stacked[dim] = (cell, np.array(low, np.float64), np.array(high, np.float64))
        for part in parts:
            out = []
            for row in part.itertuples(index=False):
                cell, low, high = stacked[row.dim]
                bounds = box_bounds(low, high, np.array(row.v).astype(low.dtype))
                for at in np.flatnonzero(bounds >= (-np.inf if pd.isna(row.kth) else row.kth)):
                    for n in range(salts[row.dim, cell[at]]):
                        target = f"{row.dim}:{cell[at]}:{n}"
                        if target != row.shard:
                            out.append((row.query_id, row.row, row.v, target, row.kth))
            yield pd.DataFrame(out, columns=["query_id", "row", "v", "shard", "kth"])

    kth = near.groupBy("row").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("kth"))
    going = asked.drop("cell").join(kth, "row", "left").mapInPandas(
        elsewhere, "query_id long, row long, v array<long>, shard string, kth long"
    )
    both = near.unionByName(searched(materialize(going, "going")))
    ranked = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return both.withColumn("rank", ranked).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


@register(
    "op8_exact_topk",
    """
    WITH v AS (
      SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT for x in embedding] AS v, len(embedding) AS dim
      FROM embeddings
      WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
        AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
    ), s AS (
      SELECT q.vec_id AS query_id, c.vec_id, list_sum([p[1] * p[2] for p in list_zip(q.v, c.v)])::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND q.dim = c.dim
    ), r AS (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
    )
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
)
def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
