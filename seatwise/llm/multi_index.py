"""Nearest neighbours by inner product with an inverted multi-index.

The two halves of the vectors are quantised apart, each with its own centroids, so k + k centroids make k * k cells. The index holds every
distinct vector in its cell. A query walks the centroid pairs by summed product of their halves with a heap until it has passed some
entries, which are ranked by the exact product. Its k-th best of them is a floor: what follows are all further cells that can hold a
product as high, by the products with the cell's centroids and the greatest residuals and norm in the cell (Cauchy-Schwarz).

Equal vectors are one entry with the least ids that any answer can need, and equal queries are searched once, so a vector that a third of
all rows share costs one row. Cells with many entries are split over several parts; a part that many queries visit is copied for
blocks of them. Entries and queries meet part by part; a part returns the best few of each query, and a rank over all parts ends it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seatwise.llm.common import written

#: Entries to a part, and queries to a block.
PART, BLOCK = 4096, 2048


def centroids(rows: np.ndarray, k: int, seed: int, steps: int = 10) -> np.ndarray:
    """k-means of a bounded sample; a centroid that loses all rows starts again at a drawn one."""
    draw = np.random.default_rng(seed)
    found = rows[draw.choice(len(rows), k, replace=len(rows) < k)].copy()
    for _ in range(steps):
        nearest = assign(rows, found)
        sums = np.zeros_like(found)
        np.add.at(sums, nearest, rows)
        n = np.bincount(nearest, minlength=k)
        found = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], rows[draw.integers(len(rows), size=k)])
    return found


def assign(rows: np.ndarray, found: np.ndarray) -> np.ndarray:
    return np.argmin((found * found).sum(axis=1)[None, :] - 2 * rows @ found.T, axis=1)


def length(rows: np.ndarray) -> np.ndarray:
    return np.sqrt((rows * rows).sum(axis=-1))


def walk(first: np.ndarray, second: np.ndarray, counts: np.ndarray, wanted: float) -> list[int]:
    """Cells in rising order of the sums of their halves until their entries are ``wanted`` (all cells, if there are fewer)."""
    one, two = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    a, b = first[one].tolist(), second[two].tolist()
    heap, seen, cells, passed = [(a[0] + b[0], 0, 0)], {(0, 0)}, [], 0
    while heap and passed < wanted:
        _, i, j = heapq.heappop(heap)
        cell = int(one[i]) * len(second) + int(two[j])
        if counts[cell]:
            cells.append(cell)
            passed += int(counts[cell])
        for p, q in ((i + 1, j), (i, j + 1)):
            if p < len(a) and q < len(b) and (p, q) not in seen:
                seen.add((p, q))
                heapq.heappush(heap, (a[p] + b[q], p, q))
    return cells


def numbers(column: pd.Series, dim: int) -> np.ndarray:
    return np.array(column.tolist(), np.float64).reshape(len(column), dim)


def search(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", every: int = 20, k: int = 20, ahead: int = 4096,
           sample: int = 20_000, per_cell: int = 64, most_centroids: int = 1024, seed: int = 11) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the ``k`` nearest of every row whose id is divisible by ``every``.

    Nearness is the inner product in double precision, ties go to the smaller vec_id, and a query's own id is left out. The centroids
    are fitted on at most ``sample`` vectors (least hashes); every vector is indexed. There are about ``per_cell`` entries to a cell,
    at most ``most_centroids`` squared cells. A query visits ``ahead`` entries first, then every cell that its bound does not exclude:
    the answer is exact, and vectors without clusters, which have their neighbours in many cells, cost nearly the whole index.

    Vectors that are null, zero, of another length than the most frequent one, or hold null or non-finite components take no part, nor do rows with a
    null id. A repeated row counts once; rows with one id and different vectors are vectors of their own. With fewer candidates
    than ``k`` all are returned; an empty table gives no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    value = F.col(vector).cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), value.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & finite)
    lengths = rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if lengths is None:
        return spark.createDataFrame([], schema)
    dim = lengths["dim"]
    half = dim // 2
    rows = rows.where(F.size("v") == dim).distinct()
    # -0.0 and 0.0 are one value in a group-by; the least k + 1 ids of a vector are all that an answer can name.
    key = F.sha2(F.concat_ws(",", F.transform("v", lambda x: F.when(x == 0, F.lit("0")).otherwise(x.cast("string")))), 256)
    keyed = written(rows.withColumn("key", key), "vectors")
    least = keyed.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy("id"))).where(F.col("place") <= k + 1)
    entries = written(least.groupBy("key").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.min("v").alias("v")), "entries")
    total = entries.count()

    drawn = entries.orderBy("key").limit(sample).select("v").toPandas()  # at most ``sample`` rows
    fitted = numbers(drawn["v"], dim)
    side = int(min(most_centroids, max(2, round((total / per_cell) ** 0.5))))
    first, second = centroids(fitted[:, :half], side, seed), centroids(fitted[:, half:], side, seed + 1)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = numbers(batch["v"], dim)
            one, two = assign(x[:, :half], first), assign(x[:, half:], second)
            yield batch.assign(cell=one * side + two, off=length(x[:, :half] - first[one]), second_off=length(x[:, half:] - second[two]), norm=length(x))

    placed = "key string, ids array<long>, v array<double>, cell long, off double, second_off double, norm double"
    celled = written(entries.mapInPandas(place, placed), "cells")
    counts, limits = np.zeros(side * side, np.int64), np.zeros((3, side * side))
    most = [F.max(c).alias(c) for c in ("off", "second_off", "norm")]
    for row in celled.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *most).toLocalIterator():  # at most side * side rows
        counts[row["cell"]] = row["n"]
        limits[:, row["cell"]] = row["off"], row["second_off"], row["norm"]
    celled = celled.drop("off", "second_off", "norm")
    # Cells are dealt over parts of about PART entries; a cell with more has several parts of its own.
    splits = np.maximum(1, -(-counts // PART))
    parts = int(max(1, -(-total // PART)))

    def part_of(cell: int, share: int) -> int:
        return int((cell * 2654435761 + share * 40503) % parts)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            share = [int(name[:15], 16) % int(splits[cell]) for name, cell in zip(batch["key"], batch["cell"], strict=True)]
            yield batch.assign(part=[part_of(cell, s) for cell, s in zip(batch["cell"], share, strict=True)])[["part", "cell", "ids", "v"]]

    def walked(one: np.ndarray, two: np.ndarray) -> list[int]:
        return walk(-one, -two, counts, min(total, max(ahead, k + 1)))

    def not_excluded(one: np.ndarray, two: np.ndarray, v: np.ndarray, floor: float) -> list[int]:
        """The cells not walked that may hold a product of ``floor`` or more."""
        near, far, whole = length(v[:half]), length(v[half:]), length(v)
        bound = np.minimum((one[:, None] + two[None, :]).ravel() + near * limits[0] + far * limits[1], whole * limits[2]) + 1e-9 * whole * limits[2]
        left = (counts > 0) & ~(bound < floor)
        left[walked(one, two)] = False
        return np.flatnonzero(left).tolist()

    def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = numbers(batch["v"], dim)
            one, two = x[:, :half] @ first.T, x[:, half:] @ second.T
            for i in range(len(batch)):
                by_part: dict[int, list[int]] = {}
                floor = float(batch["floor"].iloc[i]) if "floor" in batch else float("-inf")
                cells = not_excluded(one[i], two[i], x[i], floor) if "floor" in batch else walked(one[i], two[i])
                for cell in cells:
                    for share in range(int(splits[cell])):
                        by_part.setdefault(part_of(cell, share), []).append(cell)
                if by_part:
                    yield pd.DataFrame({"part": list(by_part), "key": batch["key"].iloc[i], "v": [batch["v"].iloc[i]] * len(by_part),
                                        "cells": [sorted(set(c)) for c in by_part.values()], "floor": floor})

    asked = keyed.where(F.col("id") % every == 0).select("key").distinct()
    wanted = entries.join(asked, "key", "left_semi").select("key", "v")
    dealt = celled.mapInPandas(deal, "part long, cell long, ids array<long>, v array<double>")

    def rerank(held: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        keys, ids, scores = [], [], []
        if len(held) and len(queries):
            held = held.sort_values("cell", kind="stable")
            x, cells = numbers(held["v"], dim), held["cell"].to_numpy()
            names = held["ids"].tolist()
            lowest = np.array([n[0] for n in names])
            for name, v, visited, floor in zip(queries["key"], queries["v"], queries["cells"], queries["floor"], strict=True):
                at = np.flatnonzero(np.isin(cells, visited))
                score = np.array([x[at] @ np.asarray(v, np.float64)]).ravel()
                high = ~(score < floor - 1e-12 * abs(floor))  # others are in no answer
                at, score = at[high], score[high]
                best = np.lexsort((lowest[at], -score))[:k + 1]
                for i in best:
                    keys.extend([name] * len(names[at[i]]))
                    ids.extend(names[at[i]])
                    scores.extend([float(score[i])] * len(names[at[i]]))
        return pd.DataFrame({"key": keys, "vec_id": ids, "score": scores}).astype({"key": object, "vec_id": "int64", "score": "float64"})

    def met(queries: DataFrame) -> DataFrame:
        """The best of each part for the queries that visit it."""
        visiting = written(queries.mapInPandas(visits, "part long, key string, v array<double>, cells array<long>, floor double"), "visits")
        blocks = visiting.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
        left = dealt.join(blocks, "part").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        right = visiting.join(blocks, "part").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")).drop("blocks")
        return left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInPandas(rerank, "key string, vec_id long, score double")

    order = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    ahead_found = written(met(wanted), "ahead")
    floors = ahead_found.withColumn("place", F.row_number().over(order)).where(F.col("place") == k + 1).select("key", F.col("score").alias("floor"))
    floored = wanted.join(floors, "key", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    found = ahead_found.unionByName(met(floored))
    best = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    best = best.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("best"))  # k + 1 entries
    answers = keyed.where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), "key").distinct().join(best, "key")
    nearest = F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, k)
    return answers.select("query_id", F.posexplode(nearest).alias("pos", "hit")).select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), "hit.vec_id", "hit.score")
