"""Exact top-k inner-product search with M-trees.

Vectors of integers are lifted by one coordinate to a common length, which turns the
order of inner products into an order of distances. The space is cut into cells
around at most ``CELLS`` sampled pivots, a cell into blocks of bounded size by hashed
id (so a vector that a third of all rows share fills many blocks, not one), and every
block gets an M-tree: pages of entries with covering radius and distance to the
parent's centre. A query goes first to a block of its nearest cell, which gives it a
bound, then to every block of the cells that the bound does not rule out. In a tree
it goes best first and skips, by stored distances alone, what cannot be near enough.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quotemill.llm.scratch import materialize

CELLS = 1024
BLOCK = 8192
QUERY_BLOCK = 4096
PAGE = 256
FAN = 16
_SLACK = 1e-6

VECTORS = "vec_id long, q binary, norm2 double"
PAGES = "cell int, block int, node int, parent int, leaf boolean, center binary, lift double, radius double, parent_dist double, ids binary, vectors binary, dists binary"
FOUND = "query_id long, vec_id long, score long"


def quantised(embeddings: DataFrame) -> DataFrame:
    """(vec_id, q, norm2): floor(256 x) of each component as 64-bit integers.

    Left out: null ids and vectors, and vectors with a null or non-finite component.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            rows = []
            for vec_id, v in zip(df["vec_id"], df["embedding"]):
                x = np.array([np.nan if c is None else c for c in v] if getattr(v, "dtype", None) == object else v, dtype=np.float64)
                if np.isfinite(x).all():
                    q = np.floor(256 * x).astype("<i8")
                    rows.append((vec_id, q.tobytes(), float(q.astype(np.float64) @ q.astype(np.float64))))
            yield pd.DataFrame(rows, columns=["vec_id", "q", "norm2"])

    return embeddings.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInPandas(scan, VECTORS)


def _matrix(raw, width: int) -> np.ndarray:
    """Rows of one width; shorter vectors end in zeros."""
    out = np.zeros((len(raw), width), dtype=np.int64)
    if len(raw) and all(len(b) == 8 * width for b in raw):
        return np.frombuffer(b"".join(raw), dtype="<i8").reshape(-1, width)
    for i, b in enumerate(raw):
        out[i, : len(b) // 8] = np.frombuffer(b, dtype="<i8")
    return out


def _lift(x: np.ndarray, most: float) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, most - (x * x).sum(axis=1)))


def build_tree(ids: np.ndarray, x: np.ndarray, most: float, seed: int = 0) -> list[tuple]:
    """Pages (node, parent, leaf, centre, lift, radius, parent distance, member rows or None, member distances)."""
    rng = np.random.default_rng(seed)
    points = np.concatenate([x.astype(np.float64), _lift(x.astype(np.float64), most)[:, None]], axis=1)

    def dist(rows: np.ndarray, center: np.ndarray) -> np.ndarray:
        return np.sqrt(((points[rows] - center) ** 2).sum(axis=1))

    out: list[tuple] = []
    stack = [(np.arange(len(ids)), points[0] if len(ids) else None, -1, None)] if len(ids) else []
    while stack:
        rows, center, parent, above = stack.pop()
        d = dist(rows, center)
        radius, node = float(d.max()), len(out)
        up = 0.0 if above is None else float(np.sqrt(((center - above) ** 2).sum()))
        leaf = len(rows) <= PAGE
        out.append((node, parent, leaf, center[:-1], float(center[-1]), radius, up, rows if leaf else None, d if leaf else None))
        if leaf:
            continue
        if radius == 0:
            stack += [(part, center, node, center) for part in np.array_split(rows, -(-len(rows) // PAGE))]
            continue
        pivots = points[np.append(rows[rng.choice(len(rows), FAN - 1, replace=False)], rows[d.argmax()])]
        near = np.stack([dist(rows, p) for p in pivots], axis=1)
        near[:, -1] = np.where(d == radius, -1, near[:, -1])  # the farthest leave the others: every split makes progress
        of = near.argmin(axis=1)
        for k in range(FAN):
            if (mine := rows[of == k]).size:
                if mine.size == len(rows):
                    if (half := rows[d < radius]).size:  # else all are at the radius, and the farthest is their centre
                        stack.append((half, center, node, center))
                    stack.append((rows[d == radius], pivots[-1], node, center))
                    break
                stack.append((mine, pivots[k], node, center))
    return out


class Tree:
    """A tree read from its pages, ready to search."""

    def __init__(self, pages: pd.DataFrame, width: int, most: float):
        pages = pages.sort_values("node")
        self.most = most
        self.centers = np.stack([np.frombuffer(b, dtype="<f8") for b in pages["center"]])
        self.radius, self.up = pages["radius"].to_numpy(), pages["parent_dist"].to_numpy()
        self.leaf = pages["leaf"].to_numpy()
        self.ids = [np.frombuffer(b, dtype="<i8") for b in pages["ids"]]
        self.vectors = [np.frombuffer(b, dtype="<i8").reshape(-1, width) for b in pages["vectors"]]
        self.width, self.peak = width, max((float(np.abs(v.astype(np.float64)).max()) for v in self.vectors if v.size), default=0.0)
        self.floats = [v.astype(np.float64) for v in self.vectors]
        self.dists = [np.frombuffer(b, dtype="<f8") for b in pages["dists"]]
        self.parent = pages["parent"].to_numpy()
        order = np.argsort(self.parent, kind="stable")
        edges = np.searchsorted(self.parent[order], np.arange(len(pages) + 1))
        self.children = [order[edges[i] : edges[i + 1]] for i in range(len(pages))]
        self.computed = 0

    def search(self, query_ids: np.ndarray, q: np.ndarray, k: int, least: np.ndarray) -> list[tuple[int, int, int]]:
        """(query id, id, score) of the k best of every query.

        ``least``: a score known to be reached k times elsewhere, NaN for none. Pages
        are visited best first, by the least bound of the queries that still want
        them; a page takes all of these at once. A query enters a page or a member
        only if its stored distances, the triangle inequality and its own best so far
        let it in.
        """
        m, qf = len(q), q.astype(np.float64)
        q2 = (qf * qf).sum(axis=1)
        exact = self.width * self.peak * float(np.abs(qf).max(initial=0.0)) < 2**52  # all sums of products are whole doubles
        rounding = np.maximum(_SLACK, np.sqrt(64 * np.finfo(np.float64).eps * self.width * (q2 + self.most)))  # of distances so long
        reach = lambda score: np.sqrt(np.maximum(0.0, q2 + self.most - 2 * score)) + _SLACK
        known = np.where(np.isnan(least), np.inf, reach(np.nan_to_num(least)))
        limit = known.copy()
        best = np.full((m, k), np.iinfo(np.int64).min)
        ids = np.full((m, k), np.iinfo(np.int64).max)
        slack = lambda who: limit[who] * (1 + 1e-12) + 2 * rounding[who]

        def distances(rows: np.ndarray, who: np.ndarray) -> np.ndarray:
            self.computed += len(rows) * len(who)
            return np.sqrt(np.maximum(0.0, (q2[who] + self.most)[:, None] - 2 * (qf[who] @ self.centers[rows].T)))

        everyone = np.arange(m)
        d0 = distances(np.array([0]), everyone)[:, 0]
        heap = [(0.0, 0, everyone, d0)]
        while heap:
            _, node, who, d = heapq.heappop(heap)
            on = np.maximum(0.0, d - self.radius[node]) <= slack(who)
            who, d = who[on], d[on]
            if not len(who):
                continue
            if not self.leaf[node]:
                kids = self.children[node]
                near = np.abs(d[:, None] - self.up[kids][None, :]) - self.radius[kids][None, :] <= slack(who)[:, None]  # by stored distances
                kids, near = kids[near.any(axis=0)], near[:, near.any(axis=0)]
                if len(kids):
                    far = distances(kids, who)
                    near &= far - self.radius[kids][None, :] <= slack(who)[:, None]
                    for j, kid in enumerate(kids.tolist()):
                        if (mine := np.flatnonzero(near[:, j])).size:
                            bound = float(np.maximum(0.0, far[mine, j] - self.radius[kid]).min())
                            heapq.heappush(heap, (bound, kid, who[mine], far[mine, j]))
                continue
            near = np.abs(d[:, None] - self.dists[node][None, :]) <= slack(who)[:, None]
            some, rows = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
            if not len(rows):
                continue
            who, near = who[some], near[np.ix_(some, rows)]
            self.computed += near.size
            score = (qf[who] @ self.floats[node][rows].T).astype(np.int64) if exact else q[who] @ self.vectors[node][rows].T
            own = self.ids[node][rows]
            near &= own[None, :] != query_ids[who][:, None]
            near &= (score >= best[who, -1][:, None]) & ~(score < least[who][:, None])
            for i in np.flatnonzero(near.any(axis=1)).tolist():
                w, at = who[i], np.flatnonzero(near[i])
                all_scores, all_ids = np.concatenate([best[w], score[i, at]]), np.concatenate([ids[w], own[at]])
                top = np.lexsort((all_ids, -all_scores.astype(np.float64) if exact else ~all_scores))[:k]
                best[w], ids[w] = all_scores[top], all_ids[top]
            full = best[who, -1] > np.iinfo(np.int64).min
            limit[who] = np.where(full, np.minimum(limit[who], np.sqrt(np.maximum(0.0, q2[who] + self.most - 2.0 * np.where(full, best[who, -1], 0))) + _SLACK), limit[who])
        at, place = np.nonzero(best > np.iinfo(np.int64).min)
        return list(zip(query_ids[at].tolist(), ids[at, place].tolist(), best[at, place].tolist()))


def top_k(embeddings: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest integer inner products.

    Queries: ids divisible by ``every``; candidates: all rows but those with the query's
    id. Ties go to the smaller id; fewer than k candidates: all. Exact repeated rows
    count once; of several vectors with one query id the least in bytes asks. Vectors
    of unequal width end in zeros. Empty table: empty result; other columns are ignored.
    """
    spark = embeddings.sparkSession
    vectors = materialize(quantised(embeddings), "vectors")
    stats = vectors.agg(F.count("*").alias("n"), F.max("norm2").alias("most"), F.max(F.length("q")).alias("width")).first()
    if not stats["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    most, width = float(stats["most"]), stats["width"] // 8
    wanted = min(CELLS, max(1, stats["n"] // BLOCK))
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "q").limit(wanted).select("q").collect()
    pivots = np.unique(_matrix([bytes(r["q"]) for r in sample], width), axis=0).astype(np.float64)
    lifted = np.concatenate([pivots, _lift(pivots, most)[:, None]], axis=1)
    square = (lifted**2).sum(axis=1)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            x = _matrix(df["q"].tolist(), width).astype(np.float64)
            p = np.concatenate([x, _lift(x, most)[:, None]], axis=1)
            d = np.maximum(0, (p**2).sum(axis=1)[:, None] + square - 2 * p @ lifted.T)
            cell = d.argmin(axis=1)
            exact = np.sqrt(((p - lifted[cell]) ** 2).sum(axis=1))
            yield df[["vec_id", "q"]].assign(cell=cell.astype(np.int32), dist=exact)

    placed = vectors.mapInPandas(assign, "vec_id long, q binary, cell int, dist double")
    found = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("dist").alias("radius")).collect()  # at most CELLS rows
    blocks = np.zeros(len(pivots), dtype=np.int64)
    radius = np.zeros(len(pivots))
    for r in found:
        blocks[r["cell"]], radius[r["cell"]] = -(-r["n"] // BLOCK), r["radius"]
    counts = F.create_map(*[x for i, n in enumerate(blocks.tolist()) for x in (F.lit(i), F.lit(max(1, n)))]) if len(blocks) <= 64 else F.array(*[F.lit(max(1, n)) for n in blocks.tolist()])
    many = counts[F.col("cell")]
    dealt = placed.withColumn("block", F.pmod(F.xxhash64("vec_id"), many).cast("int"))

    def build(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        df = df.drop_duplicates(["vec_id", "q"]).sort_values(["vec_id", "q"])
        ids, x = df["vec_id"].to_numpy(np.int64), _matrix(df["q"].tolist(), width)
        rows = []
        for node, parent, leaf, center, lift, r, up, members, dists in build_tree(ids, x, most):
            own = members if leaf else np.empty(0, dtype=np.int64)
            rows.append((*key, node, parent, leaf, center.astype("<f8").tobytes(), lift, r, up, ids[own].astype("<i8").tobytes(), x[own].astype("<i8").tobytes(), (dists if leaf else np.empty(0)).astype("<f8").tobytes()))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in PAGES.split(", ")])

    pages = materialize(dealt.select("cell", "block", "vec_id", "q").groupBy("cell", "block").applyInPandas(build, PAGES), "mtree")
    asked = vectors.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("q").alias("q")).withColumnRenamed("vec_id", "query_id")
    asked = materialize(asked, "queries")
    groups = -(-max(1, asked.count()) // QUERY_BLOCK)
    asked = asked.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int"))
    spread = pages.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))) if groups > 1 else pages.withColumn("part", F.lit(0))

    def route(first: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for df in batches:
                q = _matrix(df["q"].tolist(), width).astype(np.float64)
                d = np.sqrt(np.maximum(0, (q**2).sum(axis=1)[:, None] + most - 2 * q @ pivots.T))
                d[:, blocks == 0] = np.inf
                home = d.argmin(axis=1)
                if first:
                    yield df.assign(cell=home.astype(np.int32), block=np.int32(0))[["query_id", "q", "part", "least", "cell", "block"]]
                    continue
                least = df["least"].to_numpy(np.float64)
                limit = np.where(np.isnan(least), np.inf, np.sqrt(np.maximum(0, (q**2).sum(axis=1) + most - 2 * np.nan_to_num(least))) + _SLACK)
                row, cell = np.nonzero((d - radius[None, :] <= limit[:, None] + _SLACK) & (blocks > 0)[None, :])
                n = blocks[cell]
                row, cell = np.repeat(row, n), np.repeat(cell, n)
                block = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                go = (cell != home[row]) | (block != 0)
                yield df.iloc[row[go]].assign(cell=cell[go].astype(np.int32), block=block[go].astype(np.int32))[["query_id", "q", "part", "least", "cell", "block"]]

        return run

    def look(key: tuple, mine: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple] = []
        if len(mine) and len(queries):
            tree = Tree(mine, width, most)
            for i in range(0, len(queries), 512):
                some = queries.iloc[i : i + 512]
                rows += tree.search(some["query_id"].to_numpy(np.int64), _matrix(some["q"].tolist(), width), k, some["least"].to_numpy(np.float64, na_value=np.nan))
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])

    asks = "query_id long, q binary, part int, least long, cell int, block int"
    keys = ["cell", "block", "part"]

    def visit(queries: DataFrame, first: bool) -> DataFrame:
        routed = queries.select("query_id", "q", "part", "least").mapInPandas(route(first), asks)
        return spread.groupBy(*keys).cogroup(routed.groupBy(*keys)).applyInPandas(look, FOUND)

    start = materialize(visit(asked.withColumn("least", F.lit(None).cast("long")), True), "home")
    bound = start.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k).select("query_id", "least")
    rest = visit(asked.join(bound, "query_id", "left"), False)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = start.unionAll(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
