"""Approximate nearest neighbours by an adaptive dimension scan.

Vectors are extended by one component that makes the largest inner product the smallest distance, turned by a random
rotation, and dealt to lists around centres fitted on a bounded sample; every vector is in a list. A query looks through
the lists nearest to it. Within a list the rotated vectors lie in column blocks: after each block a partial distance is
known, and a candidate is abandoned when a hypothesis test on it (the rest of a random rotation is like the part seen)
rejects that it is among the nearest. What survives is scored on the original vectors in double precision.

How many lists a query looks through is measured, not guessed: for a bounded sample of queries the true neighbours are found
by brute force over all vectors, and the least number of lists that holds TARGET of them is used for all.

Equal vectors are one candidate with its smallest ids, so a vector that a third of all rows share costs no more than
another. Lists and their queries are dealt to tasks in blocks of bounded size.

Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do those with another number of
components than most have. Ties go to the smaller id. Rows that share id and vector are one. An empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillmark.llm.common import arrow_map, cut

#: Vectors that centres are fitted on, vectors that bound a query's distances, and queries that recall is measured on.
SAMPLE, BOUND, MEASURED = 16_384, 4_096, 128
#: Vectors of a list, lists at most, rounds of fitting, the share of true neighbours aimed at.
LIST, MOST_LISTS, FITS, TARGET = 1024, 4096, 8, 0.96
#: Candidates and queries of one task's block, queries handled at once, columns of a block, strictness of the test.
BLOCK, QUERIES, AT_ONCE, COLUMNS, STRICT = 4096, 2048, 64, 16, 2.1


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def _points(rows: DataFrame, keep: int) -> DataFrame:
    """``digest, vector, ids``: distinct vectors packed as doubles, each with its ``keep`` smallest ids."""

    def start() -> Callable[[pa.RecordBatch], Iterator[dict[str, object]]]:
        def work(batch: pa.RecordBatch) -> Iterator[dict[str, object]]:
            held: dict[bytes, set[int]] = {}
            for key, vector in zip(batch.column("id").to_pylist(), batch.column("vector").to_pylist()):
                ids = held.setdefault(np.array(vector, dtype=np.float64).tobytes(), set())
                ids.add(key)
                if len(ids) > 4 * keep:
                    held[np.array(vector, dtype=np.float64).tobytes()] = set(sorted(ids)[:keep])
            digests = [hashlib.blake2b(v, digest_size=16).digest() for v in held]
            yield {"digest": digests, "vector": list(held), "ids": [sorted(i)[:keep] for i in held.values()]}

        return work

    out = arrow_map(rows, "digest binary, vector binary, ids array<bigint>", start, 4096)
    least = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep)
    for salted in (True, False):  # copies of one vector meet in two steps
        by = [F.col("digest"), F.pmod(F.hash(F.get("ids", F.lit(0))), F.lit(64))] if salted else [F.col("digest")]
        out = out.groupBy(*by).agg(F.first("vector").alias("vector"), least.alias("ids")).select("digest", "vector", "ids")
    return out.withColumn("point", F.get("ids", F.lit(0)))


def _matrix(packed: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(packed), dtype=np.float64).reshape(len(packed), -1)


class Index:
    """Rotation, centres and sample; the same on every worker."""

    def __init__(self, sample: np.ndarray, norm: float, lists: int, seed: int = 11):
        rnd = np.random.default_rng(seed)
        self.norm = norm
        width = sample.shape[1] + 1
        self.turn = np.linalg.qr(rnd.normal(size=(width, width)))[0]
        points = self.place(sample)
        self.centres = points[np.sort(rnd.permutation(len(points))[:lists])]
        for _ in range(FITS):
            near = self.nearest(points, 1)[:, 0]
            sums = np.zeros_like(self.centres)
            np.add.at(sums, near, points)
            count = np.bincount(near, minlength=len(self.centres))
            self.centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], self.centres)
        self.sample = points[:BOUND]

    def place(self, vectors: np.ndarray) -> np.ndarray:
        """Candidates: extended to the length of the longest, then rotated."""
        rest = np.sqrt(np.maximum(self.norm**2 - (vectors**2).sum(axis=1), 0))
        return np.hstack([vectors, rest[:, None]]) @ self.turn

    def ask(self, vectors: np.ndarray) -> np.ndarray:
        """Queries: extended by nothing, then rotated."""
        return vectors @ self.turn[:-1]

    def nearest(self, points: np.ndarray, count: int) -> np.ndarray:
        far = (self.centres**2).sum(axis=1) - 2 * points @ self.centres.T
        return np.argsort(far, axis=1, kind="stable")[:, :count]

    def reach(self, asked: np.ndarray, count: int) -> np.ndarray:
        """Squared distance of the count-th nearest in the sample: the count-th nearest of all is no farther."""
        if len(self.sample) < count:
            return np.full(len(asked), np.inf)
        far = (asked**2).sum(axis=1)[:, None] + (self.sample**2).sum(axis=1) - 2 * asked @ self.sample.T
        return np.partition(far, count - 1, axis=1)[:, count - 1] * (1 + 1e-9) + 1e-9


def scan(candidates: np.ndarray, asked: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, candidate) that no test on a partial distance rejected."""
    width = candidates.shape[1]
    cuts = list(range(0, width, COLUMNS))
    blocks = [np.ascontiguousarray(candidates[:, c : c + COLUMNS]) for c in cuts]
    own = [(b**2).sum(axis=1) for b in blocks]
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for first in range(0, len(asked), AT_ONCE):
        q, limit = asked[first : first + AT_ONCE], reach[first : first + AT_ONCE]

        def bound(seen: int) -> np.ndarray:
            return limit if seen >= width else limit * (seen / width) * (1 + STRICT / math.sqrt(seen)) ** 2

        part = (q[:, :COLUMNS] ** 2).sum(axis=1)[:, None] + own[0] - 2 * q[:, :COLUMNS] @ blocks[0].T
        at, who = np.nonzero(part <= bound(COLUMNS)[:, None])
        part = part[at, who]
        for c, block, squares in zip(cuts[1:], blocks[1:], own[1:]):
            ask = q[:, c : c + COLUMNS]
            part = part + (ask**2).sum(axis=1)[at] + squares[who] - 2 * np.einsum("ij,ij->i", ask[at], block[who])
            stays = part <= bound(c + COLUMNS)[at] + 1e-9
            at, who, part = at[stays], who[stays], part[stays]
        out.append((at + first, who))
    return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


def best(queries: np.ndarray, points: np.ndarray, scores: np.ndarray, keep: int) -> np.ndarray:
    """Positions of the ``keep`` best of each query, smaller points first among equals."""
    order = np.lexsort((points, -scores, queries))
    first = np.searchsorted(queries[order], queries[order])
    return order[np.arange(len(order)) - first < keep]


def _top(rows: DataFrame, by: str, keep: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "point"))
    return rows.withColumn("place", place).where(F.col("place") <= keep)


def _true(points: DataFrame, vectors: np.ndarray, keep: int) -> DataFrame:
    """The nearest points of a few vectors, by brute force over all points; with the lists they lie in."""
    shared = points.sparkSession.sparkContext.broadcast(vectors)

    def start() -> Callable[[pa.RecordBatch], Iterator[dict[str, object]]]:
        def work(batch: pa.RecordBatch) -> Iterator[dict[str, object]]:
            found = shared.value @ _matrix(batch.column("vector").to_pylist()).T
            count = min(keep, found.shape[1])
            which = np.argpartition(-found, count - 1, axis=1)[:, :count]
            yield {
                "asked": np.repeat(np.arange(len(found)), count),
                "point": batch.column("point").to_numpy()[which].ravel(),
                "list": batch.column("list").to_numpy()[which].ravel(),
                "score": np.take_along_axis(found, which, axis=1).ravel(),
            }

        return work

    rows = arrow_map(points.select("point", "list", "vector"), "asked int, point bigint, list int, score double", start, 4096)
    return _top(rows, "asked", keep)


def _looked_through(points: DataFrame, probing: DataFrame, shared: object, keep: int) -> DataFrame:
    """``asked, point, score``: the best of each block for every query (``asked, vector, reach, list``) that looks there."""
    # at most MOST_LISTS rows: how many blocks of candidates and of queries a list is cut into
    held = points.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    wanted = probing.groupBy("list").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("turns"))
    grid = cut(held.join(wanted, "list"))
    left = points.join(grid, "list").select(
        "list",
        F.pmod(F.xxhash64("point"), "blocks").cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"),
        "point",
        "vector",
    )
    right = probing.join(grid, "list").select(
        "list",
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
        F.pmod(F.xxhash64("asked"), "turns").cast("int").alias("turn"),
        "asked",
        "vector",
        "reach",
    )

    def look(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(candidates) or not len(queries):
            return pd.DataFrame({"asked": [], "point": [], "score": []})
        own, ask = _matrix(candidates["vector"].tolist()), _matrix(queries["vector"].tolist())
        at, who = scan(shared.value.place(own), shared.value.ask(ask), queries["reach"].to_numpy())
        scores = np.concatenate([(ask[at[i : i + 65536]] * own[who[i : i + 65536]]).sum(axis=1) for i in range(0, max(len(at), 1), 65536)])
        asked, point = queries["asked"].to_numpy()[at], candidates["point"].to_numpy()[who]
        chosen = best(asked, point, scores, keep)
        return pd.DataFrame({"asked": asked[chosen], "point": point[chosen], "score": scores[chosen]})

    cell = ["list", "block", "turn"]
    return left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInPandas(look, "asked bigint, point bigint, score double")


def search(table: DataFrame, queries: Column, k: int, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row that ``queries`` holds for, the k nearest other rows found."""
    spark, keep = table.sparkSession, k + 1
    vector = table[column].cast("array<double>")
    rows = table.select(table[key].cast("long").alias("id"), vector.alias("vector"), queries.alias("asks")).where(usable(F.col("vector")))
    sizes = rows.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").first()
    result = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], result)
    rows = rows.where(F.size("vector") == sizes["size"])
    points = cut(_points(rows.select("id", "vector"), keep))

    longest = F.max(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)).alias("longest")
    norm = math.sqrt(rows.agg(longest).first()["longest"])
    n = points.count()
    lists = min(MOST_LISTS, max(1, round(n / LIST)))
    some = points.orderBy(F.xxhash64("digest"), "point").limit(SAMPLE).select("vector").collect()
    index = Index(_matrix([r["vector"] for r in some]), norm, lists)
    shared = spark.sparkContext.broadcast(index)

    def deal() -> Callable[[pa.RecordBatch], Iterator[dict[str, object]]]:
        def work(batch: pa.RecordBatch) -> Iterator[dict[str, object]]:
            own = shared.value.place(_matrix(batch.column("vector").to_pylist()))
            yield {
                "point": batch.column("point"),
                "vector": batch.column("vector"),
                "ids": batch.column("ids"),
                "digest": batch.column("digest"),
                "list": shared.value.nearest(own, 1)[:, 0],
            }

        return work

    points = cut(arrow_map(points, "point bigint, vector binary, ids array<bigint>, digest binary, list int", deal, 4096))

    def digest() -> Callable[[pa.RecordBatch], Iterator[dict[str, object]]]:
        def work(batch: pa.RecordBatch) -> Iterator[dict[str, object]]:
            packed = [np.array(v, dtype=np.float64).tobytes() for v in batch.column("vector").to_pylist()]
            yield {"query_id": batch.column("id"), "digest": [hashlib.blake2b(p, digest_size=16).digest() for p in packed]}

        return work

    asking = cut(arrow_map(rows.where("asks").select("id", "vector"), "query_id bigint, digest binary", digest, 4096).distinct())
    asked = points.join(asking.select("digest").distinct(), "digest").select(F.col("point").alias("asked"), "vector")
    asked = cut(asked)

    few = asked.orderBy(F.xxhash64("asked"), "asked").limit(MEASURED).select("vector").collect()
    if not few:
        return spark.createDataFrame([], result)
    tests = _matrix([r["vector"] for r in few])
    order = np.argsort(index.nearest(index.ask(tests), lists), axis=1)
    depth = sorted(int(order[r["asked"], r["list"]]) + 1 for r in _true(points, tests, keep).collect())
    probes = depth[min(len(depth) - 1, math.ceil(TARGET * len(depth)) - 1)]

    def probe() -> Callable[[pa.RecordBatch], Iterator[dict[str, object]]]:
        def work(batch: pa.RecordBatch) -> Iterator[dict[str, object]]:
            own = shared.value.ask(_matrix(batch.column("vector").to_pylist()))
            yield {
                "asked": batch.column("asked"),
                "vector": batch.column("vector"),
                "reach": shared.value.reach(own, keep),
                "lists": list(shared.value.nearest(own, probes).astype(np.int32)),
            }

        return work

    probing = arrow_map(asked, "asked bigint, vector binary, reach double, lists array<int>", probe, 256)
    probing = cut(probing).select("asked", "vector", "reach", F.explode("lists").alias("list"))
    found = cut(_top(_looked_through(points, probing, shared, keep), "asked", keep).select("asked", "point", "score"))
    # a query whose near lists hold too few within its reach looks through all lists, without a test
    enough = found.groupBy("asked").agg(F.count("*").alias("n")).where(F.col("n") >= min(keep, n))
    short = cut(asked.join(enough, "asked", "left_anti"))
    if not short.isEmpty():
        every = F.explode(F.sequence(F.lit(0), F.lit(len(index.centres) - 1))).alias("list")
        more = _looked_through(points, short.select("asked", "vector", F.lit(float("inf")).alias("reach"), every), shared, keep)
        found = cut(_top(found.unionByName(more).distinct(), "asked", keep).select("asked", "point", "score"))

    # back to rows: every point stands for its smallest ids, every asked vector for its queries
    ids = points.select("point", F.explode("ids").alias("id"))
    near = found.join(ids, "point").select("asked", "score", F.col("id").alias("point"))
    near = _top(near, "asked", keep).select("asked", "score", "point")
    of = asking.join(points.select("digest", F.col("point").alias("asked")), "digest").select("query_id", "asked")
    pairs = of.join(near, "asked").where(F.col("point") != F.col("query_id"))
    return _top(pairs, "query_id", k).select("query_id", F.col("place").cast("int").alias("rank"), F.col("point").alias("vec_id"), "score")
