"""Exact top-k inner products over norm-sorted blocks.

Vectors become integers floor(256 * x). Candidates are range-partitioned by falling length, so a block
knows the longest vector it can hold. The block of the longest ones is searched first for all queries; a
block's length times the query's own bounds its products (Cauchy-Schwarz), so each query is only sent on to
blocks that can still beat its k-th score. Inside a block, vectors are rotated by the eigenvectors of all
candidates' Gram matrix: the first few coordinates give most of the product and the lengths of the rest
bound what is missing. What survives is scored exactly.

Defined results: vectors that are null or hold a null or non-finite component take no part, nor do rows
without an id; shorter vectors count as padded with zeros; rows with the query's own id are not its
candidates; equal scores go by the smaller id; scores are longs, exact as long as they fit one; an empty table gives an empty result. Repeated rows count as
often as they are stored, as in the SQL: each copy of a candidate takes a rank of its own, and a query stored
m times pairs m times with every candidate, all under its one query_id.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralith.llm.common import materialize, table

SCALE, K, STEP = 256, 5, 50
#: Rows of a block of candidates, and of queries that meet one block in one group.
BLOCK, QUERIES = 4096, 1024
#: Rotated coordinates summed before the bound is applied.
HEAD = 16
#: No score yet: less than any, and its negative fits a long.
NONE = np.int64(-(2**63) + 1)
#: Classes of block lengths to a factor of two.
CLASSES = 8


def integers(vectors: DataFrame) -> DataFrame:
    """vec_id, v (integers) and norm2 of the vectors that take part."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    sound = F.forall(F.col("x"), lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where("vec_id IS NOT NULL AND x IS NOT NULL").where(sound)
    rows = rows.select("vec_id", F.transform("x", lambda e: F.floor(e * SCALE)).alias("v"))
    return rows.withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e))


def copies(rows: DataFrame, k: int) -> DataFrame:
    """Every (vec_id, v) as often as it is stored; k copies fill all ranks, so further ones can't change a result."""
    held = rows.groupBy("vec_id", "v").agg(F.max("norm2").alias("norm2"), F.least(F.count("*"), F.lit(k)).cast("int").alias("copies"))
    return held.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select("vec_id", "v", "norm2")


def _matrix(column, d: int) -> np.ndarray:
    """Rows as whole numbers, padded to d columns."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.diff(column.offsets.to_numpy())
    if len(sizes) and (sizes == d).all():
        return flat.reshape(-1, d)
    out = np.zeros((len(sizes), d), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _gram(d: int):
    def run(batches):
        import pyarrow as pa

        total = np.zeros((d, d))
        for batch in batches:
            m = _matrix(batch.column("v"), d).astype(np.float64)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(d), d).astype(np.int32)), pa.array(np.tile(np.arange(d), d).astype(np.int32)), pa.array(total.reshape(-1))], ["i", "j", "g"])

    return run


def best_of_block(q_ids, q, floor_, c_ids, c, k: int, rotation: np.ndarray) -> list[tuple[int, int, int]]:
    """(query, id, score): up to k candidates of the block a query, leaving out what can't reach floor_."""
    whole_q, whole_c, q, c = q, c, q.astype(np.float64), c.astype(np.float64)
    order = np.lexsort((c_ids, -(c * c).sum(axis=1)))
    c_ids, c, whole_c = c_ids[order], c[order], whole_c[order]
    head = min(HEAD, q.shape[1])
    rq, rc = q @ rotation, c @ rotation
    rest_q, rest_c = np.sqrt((rq[:, head:] ** 2).sum(axis=1)), np.sqrt((rc[:, head:] ** 2).sum(axis=1))
    size_q, size_c = np.sqrt((q * q).sum(axis=1)), np.sqrt((c * c).sum(axis=1))
    exact = float(size_q.max(initial=0)) * float(size_c.max(initial=0)) < 2.0**52
    best_s = np.full((len(q), k), NONE)
    best_i = np.full((len(q), k), np.iinfo(np.int64).max)
    for at in range(0, len(c), 256):
        part = slice(at, at + 256)
        last = best_s[:, -1]
        need = np.maximum(floor_, np.where(last == NONE, -np.inf, last.astype(np.float64)))
        slack = 1e-9 * size_q * size_c[at] + 1e-6
        live = np.flatnonzero(size_q * size_c[at] + slack >= need)
        if not len(live):
            continue
        bound = rq[live, :head] @ rc[part, :head].T + np.outer(rest_q[live], rest_c[part])
        maybe = bound + slack[live, None] >= need[live, None]
        live, maybe = live[maybe.any(axis=1)], maybe[maybe.any(axis=1)]
        cols = np.flatnonzero(maybe.any(axis=0))
        if not len(live):
            continue
        ids = c_ids[part][cols]
        if exact:
            score = (q[live] @ c[part][cols].T).astype(np.int64)
        else:  # products beyond 2^52, which floating point would round
            score = whole_q[live] @ whole_c[part][cols].T
        score = np.where(maybe[:, cols] & (q_ids[live][:, None] != ids[None, :]), score, NONE)
        all_s = np.hstack([best_s[live], score])
        all_i = np.hstack([best_i[live], np.broadcast_to(ids, score.shape)])
        rank = np.lexsort((all_i, -all_s), axis=1)[:, :k]
        best_s[live], best_i[live] = np.take_along_axis(all_s, rank, 1), np.take_along_axis(all_i, rank, 1)
    rows, cols = np.nonzero(best_s != NONE)
    return [(int(q_ids[r]), int(best_i[r, c_]), int(best_s[r, c_])) for r, c_ in zip(rows, cols, strict=True)]


def _search(queries: DataFrame, blocks: DataFrame, d: int, rotation: np.ndarray, k: int) -> DataFrame:
    """Best of each group (block, part of the queries); blocks comes once for each part that asks for it."""

    def run(key, qs, cs):
        import pyarrow as pa

        found = []
        if qs.num_rows and cs.num_rows:
            qs, cs = qs.combine_chunks(), cs.combine_chunks()
            q, c = _matrix(qs.column("v").chunk(0), d), _matrix(cs.column("c_v").chunk(0), d)
            found = best_of_block(qs.column("vec_id").to_numpy(), q, qs.column("floor").to_numpy(), cs.column("c_id").to_numpy(), c, k, rotation)
        return pa.table({"query_id": pa.array([f[0] for f in found], pa.int64()), "vec_id": pa.array([f[1] for f in found], pa.int64()), "score": pa.array([f[2] for f in found], pa.int64())})

    rows = blocks.select(F.col("block").alias("in_block"), F.col("part").alias("in_part"), F.col("vec_id").alias("c_id"), F.col("v").alias("c_v"))
    return queries.groupBy("block", "part").cogroup(rows.groupBy("in_block", "in_part")).applyInArrow(run, "query_id long, vec_id long, score long")


def _reachable(floors: DataFrame, longest: DataFrame) -> DataFrame:
    """(block, part, vec_id, floor): the blocks whose longest vector can still reach a query's floor.

    Blocks and queries meet by classes of length, from the least that can reach the floor to the longest, and
    no vector is carried along.
    """
    level = lambda x: F.floor(CLASSES * F.log2(F.greatest(x, F.lit(1e-300)))).cast("int")
    classed = longest.withColumn("class", level(F.sqrt("m")))
    low, high = classed.agg(F.min("class"), F.max("class")).first()
    need = F.when(F.col("floor") > 1, level((F.col("floor") - 1) / (F.greatest(F.sqrt("norm2"), F.lit(1e-300)) * (1 + 1e-9))) - 1)
    start = F.greatest(F.lit(low), F.coalesce(need, F.lit(low)))
    asked = floors.select("part", "vec_id", "norm2", "floor", start.alias("start")).where(F.col("start") <= F.lit(high))
    asked = asked.withColumn("class", F.explode(F.sequence("start", F.lit(high)))).join(classed, "class")
    asked = asked.withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    asked = asked.where(F.sqrt(F.col("norm2")) * F.sqrt("m") * (1 + 1e-9) + 1 >= F.col("floor"))
    return asked.select("block", "part", "vec_id", "floor").distinct()


def _first(found: DataFrame, k: int) -> DataFrame:
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k)
    return found.groupBy("query_id").agg(best.alias("b"))


def search(vectors: DataFrame, is_query, k: int = K, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other rows, copies included, for the rows where is_query holds."""
    rows = integers(vectors)
    n, d = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    parts = max(1, -(-n // block))
    placed = copies(rows, k).repartitionByRange(parts, F.col("norm2").desc(), F.col("vec_id")).withColumn("block", F.spark_partition_id())
    placed = materialize(placed, "topk-blocks")
    d = d or 1
    gram = np.zeros((d, d))
    for r in placed.select("v").mapInArrow(_gram(d), "i int, j int, g double").groupBy("i", "j").agg(F.sum("g").alias("g")).collect():
        gram[r["i"], r["j"]] = r["g"]
    rotation = np.linalg.eigh(gram)[1][:, ::-1].copy()
    longest = placed.groupBy("block").agg(F.max("norm2").alias("m"))
    parts_of_queries = max(1, n // STEP // QUERIES)
    own = placed.where(is_query).select("vec_id", "v", "norm2", F.pmod(F.xxhash64("vec_id"), F.lit(parts_of_queries)).cast("int").alias("part"))
    blocks = placed.select("block", "vec_id", "v")
    top = longest.orderBy(F.col("m").desc(), "block").first()
    top = top["block"] if top else 0
    each_part = F.explode(F.sequence(F.lit(0), F.lit(parts_of_queries - 1))).alias("part")
    first_queries = own.select(F.lit(top).alias("block"), "part", "vec_id", "v", F.lit(float("-inf")).alias("floor"))
    seed = _search(first_queries, blocks.where(F.col("block") == top).select("*", each_part), d, rotation, k)
    seed = materialize(seed, "topk-seed")
    found = seed
    if parts > 1:
        kth = seed.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score").cast("double")).alias("floor"))
        floors = own.select("part", "vec_id", "norm2").join(kth, own["vec_id"] == kth["query_id"], "left").drop("query_id")
        asked = _reachable(floors, longest.where(F.col("block") != top))
        asked = materialize(asked, "topk-asked")
        queries = asked.join(own.select("vec_id", "part", "v"), ["vec_id", "part"]).select("block", "part", "vec_id", "v", "floor")
        rows = blocks.join(asked.select("block", "part").distinct(), "block")
        found = seed.union(_search(queries, rows, d, rotation, k))
    best = _first(found, k)
    return best.select("query_id", F.posexplode("b").alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score"))


def op3_topk(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % STEP == 0)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
