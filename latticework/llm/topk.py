"""Exact top-k by inner product: vectors of falling length, SVD-rotated partial sums, Cauchy-Schwarz bounds."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import col, shared_dir, ship, stored

#: Vectors of a block, the queries that meet it at once.
BLOCK, TILE = 2048, 1024
#: Vectors of the first round, the longest ones; each round after it holds up to so many times as many as all before.
FIRST, GROWTH = 2048, 16
#: Bytes of queries, as 64-bit numbers, that a task holds: the broadcast bound. More queries make more passes.
QUERY_BYTES = 32 << 20
#: Shares of the rotated dimensions after which partial sums are held against the bounds.
CHECKPOINTS = (1 / 8, 3 / 8)
#: A checkpoint that spares a tile less than this share is left out for a task's next blocks, but for every eighth.
WORTH = 0.05
NULL_ID = (1 << 63) - 1


def integer_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, v array<long>, norm2): floor(256 x) of every component. Null vectors, and those with null or non-finite components, are left out."""
    x = F.transform(col(vec_col), lambda e: e.cast("double"))
    bad = lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))
    d = df.select(col(id_col).cast("long").alias("vec_id"), x.alias("x")).where(F.col("x").isNotNull() & ~F.exists("x", bad))
    d = d.select("vec_id", F.transform("x", lambda e: F.floor(e * 256)).alias("v"))
    return d.withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e))


def matrix(lists: pa.Array, width: int):
    """Rows of a list column as a matrix of whole numbers, shorter ones padded by zeros."""
    import numpy as np

    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


class Rotated:
    """Vectors in the rotated space: all coordinates, and the length of what each checkpoint leaves out."""

    def __init__(self, m, basis, cuts: list[int]):
        import numpy as np

        self.m, self.x = m.astype(float), m.astype(float) @ basis
        self.norm = np.sqrt((self.m**2).sum(1))
        self.rest = [np.sqrt((self.x[:, c:] ** 2).sum(1)) for c in cuts]


class Queries:
    """A group of queries with the k best candidates so far; kth is the score that a candidate must reach."""

    def __init__(self, rows, m, basis, cuts: list[int], kth, k: int):
        import numpy as np

        self.rows, self.k, self.exact, self.whole = rows, k, m, Rotated(m, basis, cuts)
        self.kth = kth.copy()
        none = np.zeros(0, np.int64)
        self.at, self.score, self.id = none, none, none  # query's place, score, id of each candidate held

    def offer(self, at, score, ids) -> None:
        """Take candidates in; of each query's, the k best stay: higher score first, then smaller id."""
        import numpy as np

        at, score, ids = np.concatenate([self.at, at]), np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, -score, at))
        at, score, ids = at[order], score[order], ids[order]
        first = np.searchsorted(at, at, "left")
        rank = np.arange(len(at)) - first
        keep = rank < self.k
        last = rank == self.k - 1
        self.kth[at[last]] = np.maximum(self.kth[at[last]], score[last])
        self.at, self.score, self.id = at[keep], score[keep], ids[keep]


class Search:
    """Blocks of vectors, each in order of falling length, against a group of queries; counts pairs met and multiplied out."""

    def __init__(self, q: Queries, basis, cuts: list[int]):
        self.q, self.basis, self.cuts, self.met, self.multiplied, self.blocks = q, basis, cuts, 0, 0, 0
        self.spared = [1.0] * len(cuts)

    def block(self, rows, ids, m) -> None:
        import numpy as np

        q, queries = self.q, self.q.whole
        self.met += len(m) * len(q.rows)
        self.blocks += 1
        long = np.sqrt((m.astype(float) ** 2).sum(1))
        order = np.argsort(-long, kind="stable")
        # A length that meets no query's bound ends the block, and the vectors are never rotated.
        reach = np.full(len(q.rows), np.inf)
        some = queries.norm > 0
        reach[some] = (q.kth[some] - 1e-6) / (queries.norm[some] * (1 + 1e-9))
        reach[~some & (q.kth <= 0)] = -np.inf
        need = reach.min() if len(reach) else np.inf
        order = order[: np.searchsorted(-long[order], -need, "right")] if need > 0 else order
        if not len(order):
            return
        rows, ids, m = rows[order], ids[order], m[order]
        v = Rotated(m, self.basis, self.cuts)
        for start in range(0, len(q.rows), TILE):
            cols = np.arange(start, min(start + TILE, len(q.rows)))
            cols = cols[reach[cols] <= v.norm[0] * (1 + 1e-9)]
            if len(cols):
                self.tile(v, rows, ids, m, cols)

    def tile(self, v: Rotated, rows, ids, m, cols) -> None:
        """Partial sums by checkpoint; rows and queries without a pair that can still reach its bound drop out."""
        import numpy as np

        q, w, live, done = self.q, self.q.whole, np.arange(len(rows)), 0
        part = np.zeros((len(live), len(cols)))
        for i, cut in enumerate(self.cuts):
            if self.spared[i] < WORTH and self.blocks % 8:
                continue
            part = part + v.x[live, done:cut] @ w.x[cols, done:cut].T
            done = cut
            high = part + v.rest[i][live, None] * w.rest[i][None, cols]
            slack = 1e-6 + 1e-9 * v.norm[live, None] * w.norm[None, cols]
            alive = high >= q.kth[cols][None, :] - slack
            r, c = alive.any(1), alive.any(0)
            self.spared[i] = 1 - (r.sum() * c.sum()) / max(1, alive.size)
            live, cols, part = live[r], cols[c], part[np.ix_(r, c)]
            if not len(live) or not len(cols):
                return
        self.multiplied += len(live) * len(cols)
        if v.norm[live].max() * w.norm[cols].max() < 2**53:  # every sum of these products is a whole number that a double holds
            scores = (v.m[live] @ w.m[cols].T).astype(np.int64)
        else:
            scores = m[live] @ q.exact[cols].T
        own = rows[live][:, None] == q.rows[cols][None, :]
        floor = q.kth[cols]
        if len(live) > 4 * q.k:  # no more than k and those equal to the k-th can stay
            level = np.where(own, np.iinfo(np.int64).min, scores)
            floor = np.maximum(floor, np.partition(level, len(live) - q.k, axis=0)[len(live) - q.k])
        at, to = np.nonzero((scores >= floor[None, :]) & ~own)
        if len(at):
            q.offer(cols[to], scores[at, to], ids[live][at])


def _second_moments(vecs: DataFrame, width: int):
    """Sum of the outer products of all vectors: the SVD's right side comes from it."""
    import numpy as np

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = np.zeros((width, width))
        for b in batches:
            for s in range(0, b.num_rows, BLOCK):
                m = matrix(b.column(0).slice(s, BLOCK), width).astype(float)
                g += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(list(g), pa.list_(pa.float64()))], ["i", "g"])

    sums = [F.sum(F.get("g", j)).alias(f"c{j}") for j in range(width)]
    gram = np.zeros((width, width))
    for r in vecs.select("v").mapInArrow(moments, "i int, g array<double>").groupBy("i").agg(*sums).collect():
        gram[r["i"]] = r[1:]
    return gram


def top_k(df: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vec_col: str = "embedding", report: dict | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row whose id is divisible by `every`, its k highest integer inner products with the other rows.

    Ties go to the smaller vec_id, null ids last. Each row is a query and a candidate by itself, also where ids repeat: a
    repeated query id has a result for each of its rows, and rows of its own id are candidates. Shorter vectors count as
    padded by zeros. Fewer than k others: all of them. An empty table, or one without queries, gives none. Scores must fit 64 bits.

    The rows are stored by rounds of falling length, each up to GROWTH times as large as all before, without a shuffle.
    Queries come in groups of QUERY_BYTES at most and are broadcast; a pass of a group maps a round's vectors where they
    lie. A block is read longest first: what cannot reach any query's k-th score by its length is not looked at; the others
    are rotated by the eigenvectors of the whole table's second moments, and at each checkpoint pairs go whose partial sum
    and the product of the rests' lengths stay below the bound. The rest is multiplied out in whole numbers. Bounds rise
    with each tile, and from round to round over all tasks; a round that no query's bound can reach is skipped.

    report, if given, receives pairs (queries by candidates), and how many were multiplied out.
    """
    import numpy as np

    spark = df.sparkSession
    ship(spark)
    shape = "q long, vec_id long, score long, met long, multiplied long"
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    vecs = stored(integer_vectors(df, id_col, vec_col).withColumn("row", F.monotonically_increasing_id()), "topk-vectors")
    n, width = vecs.agg(F.count("*"), F.max(F.size("v"))).first()
    asked = vecs.where(F.col("vec_id") % every == 0)
    n_asked = asked.count()
    if not width or not n_asked:
        return none
    _, basis = np.linalg.eigh(_second_moments(vecs, width))
    basis = np.ascontiguousarray(basis[:, ::-1])  # strongest direction first
    cuts = sorted({max(1, round(width * c)) for c in CHECKPOINTS} - {width})

    sizes = [FIRST]
    while sum(sizes) < n:
        sizes.append(sum(sizes) * (GROWTH - 1))
    shares = [1 - s / n for s in np.cumsum(sizes)[:-1].tolist()]
    edges = [float(x) for x in vecs.agg(F.percentile_approx("norm2", shares, 100_000)).first()[0]] if shares else []
    rounds = reduce(lambda at, e: at + (F.col("norm2") < e).cast("int"), edges, F.lit(0))
    path = f"{shared_dir(spark)}/topk-rounds-{uuid.uuid4().hex}"
    vecs.withColumn("round", rounds).write.option("compression", "zstd").partitionBy("round").parquet(path)
    by_round = spark.read.schema("vec_id long, v array<long>, norm2 double, row long, round int").parquet(path)

    def search(group, bounds):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows, m = group.value
            s = Search(Queries(rows, m, basis, cuts, bounds.value, k), basis, cuts)
            for b in batches:
                for start in range(0, b.num_rows, BLOCK):
                    part = b.slice(start, BLOCK)
                    ids = part.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False)
                    s.block(part.column(2).to_numpy(), ids, matrix(part.column(1), width))
            q, end = s.q, [None]
            keep = q.score >= q.kth[q.at]
            held = [q.rows[q.at[keep]], q.id[keep], q.score[keep]]
            nothing = [None] * int(keep.sum())
            yield pa.RecordBatch.from_arrays(
                [*[pa.concat_arrays([pa.array(x, pa.int64()), pa.array(end, pa.int64())]) for x in held], pa.array([*nothing, s.met], pa.int64()), pa.array([*nothing, s.multiplied], pa.int64())],
                ["q", "vec_id", "score", "met", "multiplied"],
            )

        return run

    low, met, multiplied, results = np.iinfo(np.int64).min, 0, 0, []
    groups = -(-n_asked * width * 8 // QUERY_BYTES)
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    for g in range(groups):
        some = asked.where(F.pmod(F.xxhash64("row"), F.lit(groups)) == g).select("row", "v").toArrow()
        if not some.num_rows:
            continue
        rows = some["row"].to_numpy()
        kth, long = np.full(len(rows), low), matrix(some["v"], width).astype(np.int64)
        group = spark.sparkContext.broadcast((rows, long))
        norms, best = np.sqrt((long.astype(float) ** 2).sum(1)), None
        for i in range(len(edges) + 1):
            top = edges[i - 1] ** 0.5 if i else np.inf
            if best is not None and not (top * norms * (1 + 1e-9) + 1e-6 >= kth).any():
                break
            bounds = spark.sparkContext.broadcast(kth)
            found = stored(by_round.where(F.col("round") == i).select("vec_id", "v", "row").mapInArrow(search(group, bounds), shape), "topk-found")
            counts = found.agg(F.sum("met"), F.sum("multiplied")).first()
            met, multiplied = met + (counts[0] or 0), multiplied + (counts[1] or 0)
            new = found.where("q is not null").select("q", "vec_id", "score")
            best = stored((best.drop("rank").unionByName(new) if best is not None else new).withColumn("rank", place).where(F.col("rank") <= k), "topk-best")
            if i < len(edges):
                level = best.where(F.col("rank") == k).select("q", "score").toArrow()
                order = np.argsort(rows)
                kth[order[np.searchsorted(rows[order], level["q"].to_numpy())]] = level["score"].to_numpy()
        results.append(best)
    if report is not None:
        report.update(pairs=n * n_asked, met=met, multiplied=multiplied)
    ids = asked.select(F.col("row").alias("q"), F.col("vec_id").alias("query_id"))
    out = reduce(DataFrame.unionByName, results).join(ids, "q")
    return out.select("query_id", "rank", F.when(F.col("vec_id") != NULL_ID, F.col("vec_id")).alias("vec_id"), "score")
