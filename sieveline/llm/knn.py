"""Exact top-k search by inner product as a Voronoi kNN join.

Pivots are vectors of the data, about 2 sqrt(rows) of them; data are assigned to their nearest pivot and stored with the distance and
the angle to it. The cells' summaries, the k + 1 smallest distances of distinct ids, give every query q a bound that its k-th best score
reaches: with |x - p| <= d, q.x >= q.p - |q| d. The other way round an object at the distance d and the angle a from the pivot p scores
q.p + |q| d at most, and |q| |x| cos(angle(q, p) - a). So a query needs from a cell only objects that are at least (bound - q.p) / |q|
away and turned from the pivot by at least angle(q, p) - arccos(bound / (|q| |x|)), with the largest |x| of the cell. Queries are grouped by cell (large
cells are split, small ones joined with near ones), a group keeps the smallest such distance and angle of each cell that can hold one,
and an object is sent only to the groups that it may serve, dealt there into chunks by a hash of its row, so that a cell of copies is no hot
task. Queries go to the chunks of their own group alone. Each (group, chunk) is solved by exact integer scores, and the best k of a
query's chunks remain.

The reaches are a table of (group, cell); it is broadcast while it is small, else joined by cell and salt. Only pivots and summaries, about
sqrt(rows) of them, are on the driver. Vectors of high dimension without clusters can't be pruned by any such bound: each group then
needs nearly all objects, and the join costs as much as comparing all.

Defined cases: vectors that are null or hold null or non-finite components take no part; shorter vectors count as filled up with zeros;
ties go to the smaller id; equal ids never match each other; rows of the data that repeat count once each, those of a query id
are answered once; fewer than k candidates are all returned; empty tables give no rows. Scores are exact while they fit in
64 bits. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sieveline.llm.common import mapped, stash

#: Relative error that floats are given.
SLACK = 1e-9


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    v = F.col(vector_col).cast("array<double>")
    fit = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.filter(fit & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x * scale).cast("long")).alias("v"))


def matrix(column, width: int) -> np.ndarray:
    """The integer lists of an Arrow column as rows of at least `width` columns, filled up with zeros."""
    if hasattr(column, "combine_chunks"):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    width = max(width, int(sizes.max(initial=0)))
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = column.flatten().to_numpy()
    return out


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products; floats are exact below 2**53."""
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if float(np.abs(a.astype(float)).max()) * float(np.abs(b.astype(float)).max()) * width < 2**53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a @ b.T


class Cells:
    """What every task knows of the cells: the pivots and, once they are measured, the summaries."""

    def __init__(self, centres: np.ndarray):
        self.centres, self.norm = centres.astype(float), np.sqrt((centres.astype(float) ** 2).sum(1))
        self.width = centres.shape[1]

    def products(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Inner products with all pivots, and norms."""
        x = v.astype(float)
        return x[:, : self.width] @ self.centres.T, np.sqrt((x * x).sum(1))

    def place(self, v: np.ndarray) -> tuple[np.ndarray, ...]:
        """Cell, distance to its pivot, angle to it and norm."""
        dots, norm = self.products(v)
        cell = ((self.norm**2)[None, :] - 2 * dots).argmin(1)
        x, own = v.astype(float), np.arange(len(v))
        d = np.sqrt(((x[:, : self.width] - self.centres[cell]) ** 2).sum(1) + (x[:, self.width :] ** 2).sum(1))
        return cell, d, angles(dots[own, cell], norm, self.norm[cell], np.pi), norm

    def order(self) -> np.ndarray:
        """The cells, near ones side by side: halved again and again across the longest axis."""
        todo, out = [np.arange(len(self.centres))], []
        while todo:
            own = todo.pop()
            if len(own) > 1 and self.width:
                apart = self.centres[own] - self.centres[own].mean(0)
                own = own[np.argsort(apart @ np.linalg.eigh(apart.T @ apart)[1][:, -1], kind="stable")]
                todo += [own[len(own) // 2 :], own[: len(own) // 2]]
            else:
                out.append(own)
        return np.concatenate(out)

    def reach(self, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The least distance and the least angle, by cell, that an object has which one of the queries v may need."""
        d, angle = np.full(len(self.centres), np.inf), np.full(len(self.centres), np.inf)
        for at in range(0, len(v), 32):
            dots, norm = self.products(v[at : at + 32])
            reached, norm = norm[:, None, None] * self.least[None], norm[:, None]
            low = (dots[:, :, None] - reached - SLACK * (norm * self.norm[None])[:, :, None] - SLACK * reached).reshape(len(dots), -1)
            # one of the k + 1 best may be the query itself
            bound = (np.partition(low, -(k + 1), axis=1)[:, -(k + 1)] if low.shape[1] > k else np.full(len(low), -np.inf))[:, None]
            with np.errstate(divide="ignore", invalid="ignore"):
                need = (bound - dots) / norm
                need = need - SLACK * (np.abs(bound) / norm + self.norm[None]) - 1e-6
                share = bound / (norm * self.longest[None])
            need = np.where((norm > 0) & np.isfinite(bound), need, -np.inf)
            open_ = (norm == 0) | ~(bound > 0)
            turn = angles(dots, norm, self.norm[None], -np.inf) - np.arccos(np.clip(np.where(open_, 0, share), 0, 1)) - 1e-6
            turn = np.where(open_, -np.inf, np.where(share > 1 + SLACK, np.inf, turn))
            d, angle = np.minimum(d, need.min(0)), np.minimum(angle, turn.min(0))
        return d, angle


def angles(dots: np.ndarray, a: np.ndarray, b: np.ndarray, none: float) -> np.ndarray:
    """Angles from inner products and norms; `none` where a norm is zero."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where((a > 0) & (b > 0), np.arccos(np.clip(np.nan_to_num(dots / (a * b)), -1, 1)), none)


def pivots_of(data: DataFrame, count: int):
    """About `count` distinct vectors, those of the least hashes; only hashes are shuffled to find them. Null if there are none."""
    mark = F.xxhash64("v").alias("mark")
    some = data.select(mark).distinct().orderBy("mark").limit(count)
    found = data.select(mark, "v").join(F.broadcast(some), "mark").groupBy("mark").agg(F.min("v").alias("v")).orderBy("mark").select("v").toArrow()
    return matrix(found.column("v"), 0) if found.num_rows else None


def knn(queries: DataFrame, data: DataFrame, k: int, pivots: int | None = None, group_rows: int = 1024, chunk_rows: int = 4096, most: int = 500_000, salt_rows: int = 1 << 16) -> DataFrame:
    """query_id, rank, id, score. Both frames: id long, v array<long>. most: rows of the table of reaches that are broadcast."""
    import pyarrow as pa

    spark = data.sparkSession
    total = data.count()
    centres = pivots_of(data, pivots or max(128, 2 * math.isqrt(total)))
    if centres is None:
        return spark.createDataFrame([], "query_id long, rank int, id long, score long")
    known = Cells(centres)

    def dealt(batches):
        for batch in batches:
            if batch.num_rows:
                cell, d, angle, norm = known.place(matrix(batch.column(1), known.width))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell.astype(np.int32)), pa.array(d), pa.array(angle), pa.array(norm)], ["id", "v", "cell", "d", "angle", "norm"])

    dealt_as = "id long, v array<long>, cell int, d double, angle double, norm double"
    objects = stash(mapped(data.select("id", "v"), dealt, dealt_as).withColumn("row", F.monotonically_increasing_id()))
    sizes = objects.groupBy("cell").agg(F.count("*").alias("n"), F.max("d").alias("d"), F.max("angle").alias("angle"), F.max("norm").alias("norm")).collect()  # one row a pivot
    held, radius, widest, longest = (np.zeros(len(centres)) for _ in range(4))
    for r in sizes:
        held[r["cell"]], radius[r["cell"]], widest[r["cell"]], longest[r["cell"]] = r["n"], r["d"], r["angle"], r["norm"]
    # an id counts once in a cell, and once in all of them below, so that the copies of a query take one place
    nearest = F.row_number().over(Window.partitionBy("cell").orderBy("d", "id"))
    near = objects.groupBy("cell", "id").agg(F.min("d").alias("d")).withColumn("place", nearest).filter(F.col("place") <= k + 1).orderBy("cell", "place").collect()
    seen, least = set(), np.full((len(centres), k + 1), np.inf)
    for r in near:
        if r["id"] not in seen:
            seen.add(r["id"])
            least[r["cell"], r["place"] - 1] = r["d"]
    known.least, known.longest = least, longest

    asking = stash(mapped(queries.select("id", "v").dropDuplicates(["id"]), dealt, dealt_as).select("id", "v", "cell"))
    count = np.zeros(len(centres), np.int64)
    for r in asking.groupBy("cell").agg(F.count("*").alias("n")).collect():
        count[r["cell"]] = r["n"]
    place, before = known.order(), np.zeros(len(centres), np.int64)
    before[place] = np.cumsum(count[place]) - count[place]
    table = spark.createDataFrame([(i, *x) for i, x in enumerate(zip(before.tolist(), np.maximum(count, 1).tolist(), held.astype(int).tolist(), strict=True))], "cell int, before long, many long, n long")
    part = F.floor((F.col("before") + F.pmod(F.xxhash64("id"), "many")) / group_rows).cast("int")
    grouped = asking.join(F.broadcast(table), "cell").select(part.alias("part"), "id", "v")

    def needed(key, group):
        d, angle = known.reach(matrix(group.column("v"), known.width), k)
        cell = np.flatnonzero((held > 0) & (d <= radius) & (angle <= widest))
        return pa.table([pa.array(np.full(len(cell), key[0].as_py(), np.int32)), pa.array(cell.astype(np.int32)), pa.array(d[cell]), pa.array(angle[cell])], ["part", "cell", "least_d", "least_angle"])

    reach = stash(grouped.groupBy("part").applyInArrow(needed, "part int, cell int, least_d double, least_angle double"))
    chunks = reach.join(F.broadcast(table), "cell").groupBy("part").agg(F.ceil(F.sum("n") / chunk_rows).cast("int").alias("chunks"))
    reach = reach.join(chunks, "part")
    if reach.count() <= most:
        sent = objects.join(F.broadcast(reach), "cell")
    else:  # large cells meet their groups in several tasks
        salts = table.select("cell", F.ceil(F.col("n") / salt_rows).cast("int").alias("salts"))
        sent = objects.join(F.broadcast(salts), "cell").withColumn("salt", F.pmod(F.xxhash64("row"), "salts").cast("int"))
        sent = sent.join(reach.join(F.broadcast(salts), "cell").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts"), ["cell", "salt"])
    sent = sent.filter((F.col("d") >= F.col("least_d")) & (F.col("angle") >= F.col("least_angle")))
    sent = sent.select("part", F.pmod(F.xxhash64("row"), "chunks").cast("int").alias("chunk"), "id", "v")
    asked = grouped.join(chunks, "part").select("part", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "id", "v")

    def solve(q, x):
        out = [(np.zeros(0, np.int64),) * 3]
        if len(q) and len(x):
            x = x.sort_by("id")
            ids, mine, vectors, own_v = x["id"].to_numpy(), q["id"].to_numpy(), matrix(x["v"], known.width), matrix(q["v"], known.width)
            for at in range(0, len(q), 256):
                own = mine[at : at + 256]
                s = scores(own_v[at : at + 256], vectors)
                other = own[:, None] != ids[None, :]
                for i in range(len(own)):
                    can = np.flatnonzero(other[i])
                    if len(can) > k:
                        kth = np.partition(s[i, can], -k)[-k]
                        can = can[s[i, can] >= kth]
                    can = can[np.lexsort((ids[can], -s[i, can]))][:k]
                    out.append((np.full(len(can), own[i]), ids[can], s[i, can]))
        return pa.table([pa.array(np.concatenate(y)) for y in zip(*out, strict=True)], ["query_id", "id", "score"])

    found = asked.groupBy("part", "chunk").cogroup(sent.groupBy("part", "chunk")).applyInArrow(solve, "query_id long, id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def top_k(vectors: DataFrame, is_query, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", **how) -> DataFrame:
    """The rows for which the condition holds, against all other rows."""
    data = quantised(vectors, id_col, vector_col, scale)
    return knn(data.filter(is_query(F.col("id"))), data, k, **how)
