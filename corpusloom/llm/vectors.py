"""Exact top-k search by inner product: KD-trees per shard, best-first, with a propagated kth score.

1. Median splits of the widest dimension, found on a bounded sample, deal all vectors to at most MOST_LEAVES leaves;
   a leaf of more than SHARD_ROWS rows is dealt on by a hash, so a shard is bounded also where one vector is most rows.
2. Each shard's tree is built once: it splits at medians of the widest dimension and keeps a tight bounding box at
   each node.  The inner product of a query with any vector of a box is at most the sum over dimensions of the larger
   product with the box's two ends.
3. Queries go to shards in waves: to their own, then to the NEXT ones of the best bounds, then to all others.  Between
   waves the kth scores so far are propagated, and a query goes only to shards whose leaf's bound reaches its kth
   score; in a shard it walks the tree from the node with the best bound and stops where no bound reaches it.

A partition holds the trees of its shards, each followed by its queries, so a task has one tree and one batch of
queries in memory.  Queries come in blocks of QUERY_ROWS, each with its own copy of the trees.  The boxes of the leaves
go to all tasks: at most MOST_LEAVES rows per vector length.

Defined results: rows without vec_id, and vectors that are null or hold null or non-finite components, take no
part; vectors are compared with those of their own length only; repeated rows are candidates of their own, and
a query leaves out its own row alone (rows of one vec_id are told apart by number); ties go to the smaller
vec_id; an empty table gives no rows; other columns are ignored.  Scores are exact in 64 bits; vectors so large that
a score could leave them stop the job.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SHARD_ROWS, QUERY_ROWS, LEAF_ROWS = 8_192, 100_000, 128
#: Rows on which the splits among leaves are found (every row is dealt by them); leaves; shards of the second wave.
SAMPLE_ROWS, MOST_LEAVES, NEXT = 20_000, 256, 4
_PAIR = "query_id long, qcopy int, vec_id long, copy int, score long"
_ASKED = "shard int, kind int, block int, vec_id long, copy int, v array<long>, floor double, tree binary"


def quantised(embeddings: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id, copy, v: floor(scale * x) of each component."""
    whole = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.coalesce(whole, F.lit(False)))
    rows = rows.select("vec_id", F.transform("embedding", lambda x: F.floor(scale * x.cast("double"))).alias("v"))
    return rows.withColumn("copy", F.row_number().over(Window.partitionBy("vec_id").orderBy("v")))


class Tree:
    """A KD-tree over the rows of ``v``; node k has its rows in ``order[first[k]:last[k]]``."""

    def __init__(self, v: np.ndarray, leaf: int = LEAF_ROWS):
        self.order, self.first, self.last, self.left, lows, highs = np.arange(len(v)), [], [], [], [], []

        def grow(a: int, b: int) -> int:
            k = len(self.first)
            rows = v[self.order[a:b]]
            low, high = rows.min(axis=0), rows.max(axis=0)
            self.first.append(a)
            self.last.append(b)
            self.left.append((-1, -1))
            lows.append(low)
            highs.append(high)
            if b - a > leaf and v.shape[1] and (high > low).any():
                d = int(np.argmax(high - low))
                half = (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(rows[:, d], half)]
                self.left[k] = (grow(a, a + half), grow(a + half, b))
            return k

        grow(0, len(v))
        self.v = v[self.order]
        self.low, self.high = np.array(lows), np.array(highs)

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """For each query and node, what no inner product with a vector of the node exceeds."""
        return np.maximum(q, 0) @ self.high.T + np.minimum(q, 0) @ self.low.T


def operands(*arrays: np.ndarray) -> list[np.ndarray]:
    """The arrays as doubles where all inner products are exact in them, else as integers."""
    most = [int(np.abs(a.astype(object)).max()) if a.size else 0 for a in arrays]
    bound = most[0] * most[1] * max(1, arrays[0].shape[1])
    if bound >= 2**63:
        raise ValueError("an inner product may leave 64 bits")
    return [a.astype(np.float64) for a in arrays] if bound < 2**52 else list(arrays)


def search_tree(tree: Tree, ids, copies, q: np.ndarray, own: list[tuple[int, int]], floor: np.ndarray, k: int):
    """For each query (row of q; own: its vec_id and copy), the k best (score, vec_id, copy) of at least its floor."""
    bounds = tree.bounds(q)
    ids, copies = ids[tree.order], copies[tree.order]
    for row in range(len(q)):
        best: list = []  # a heap of (score, -vec_id, -copy): the worst is first
        kth, b = floor[row], bounds[row]
        heap = [(-b[0], 0)]
        while heap and -heap[0][0] >= kth:
            node = heapq.heappop(heap)[1]
            children = tree.left[node]
            if children[0] >= 0:
                for c in children:
                    if b[c] >= kth:
                        heapq.heappush(heap, (-b[c], c))
                continue
            a, z = tree.first[node], tree.last[node]
            scores = tree.v[a:z] @ q[row]
            good = np.flatnonzero(scores >= kth)
            if len(good) > 4 * k:  # of one leaf no more than the k best (and one for the query's own row), ties by id
                good = good[np.lexsort((copies[a:z][good], ids[a:z][good], -scores[good]))[: k + 1]]
            for i in good:
                item = (int(scores[i]), -int(ids[a + i]), -int(copies[a + i]))
                if (-item[1], -item[2]) == own[row]:
                    continue
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
            if len(best) == k:
                kth = max(kth, best[0][0])
        yield row, best


def splits(sample: np.ndarray, depth: int) -> list[tuple[int, int]]:
    """(dimension, cut) of each node of a complete tree of median splits, the root first."""
    nodes, out = [sample], []
    for _ in range(depth):
        below = []
        for rows in nodes:
            d = int(np.argmax(rows.max(axis=0) - rows.min(axis=0))) if len(rows) else 0
            at = int(np.median(rows[:, d])) if len(rows) else 0
            out.append((d, at))
            below += [rows[rows[:, d] <= at], rows[rows[:, d] > at]] if len(rows) else [rows, rows]
        nodes = below
    return out


def leaf_of(v: Column, nodes: list[tuple[int, int]]) -> Column:
    """The leaf of a vector, from 0: one comparison per level."""
    numbers = lambda k: F.split(F.lit(",".join(str(x[k]) for x in nodes)), ",")
    at = F.lit(0)
    for _ in range((len(nodes) + 1).bit_length() - 1):
        dimension, edge = F.get(numbers(0), at).cast("int"), F.get(numbers(1), at).cast("long")
        at = 2 * at + F.when(F.get(v, dimension) > edge, 2).otherwise(1)
    return at - len(nodes)


def build(rows: pd.DataFrame) -> pd.DataFrame:
    """The trees of one shard, one for each length of vectors, and their boxes."""
    out = []
    for n, own in rows.groupby(rows["v"].map(len)):
        v = np.array(own["v"].tolist(), np.int64).reshape(len(own), n)
        tree = Tree(v)
        ids, copies = own["vec_id"].to_numpy()[tree.order], own["copy"].to_numpy()[tree.order]
        saved = pickle.dumps((n, tree.first, tree.last, tree.left, tree.low, tree.high, tree.v, ids, copies))
        out.append((int(rows["shard"].iloc[0]), int(rows["leaf"].iloc[0]), n, tree.low[0].tolist(), tree.high[0].tolist(), saved))
    return pd.DataFrame(out, columns=["shard", "leaf", "n", "low", "high", "tree"])


def ask(k: int):
    """Trees and queries in order of shard: the trees of a shard come first and answer the queries that follow."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, trees = None, {}
        for batch in batches:
            out = []
            for (shard, block, kind), rows in batch.groupby(["shard", "block", "kind"], sort=True):
                if at != (shard, block):
                    at, trees = (shard, block), {}
                if kind == 0:
                    for saved in rows["tree"]:
                        n, *parts = pickle.loads(saved)
                        trees[n] = parts
                    continue
                for n, q in rows.groupby(rows["v"].map(len)):
                    if n not in trees:
                        continue
                    tree = Tree.__new__(Tree)
                    tree.first, tree.last, tree.left, tree.low, tree.high, v, ids, copies = trees[n]
                    tree.order = np.arange(len(v))
                    tree.v, w = operands(v, np.array(q["v"].tolist(), np.int64).reshape(len(q), n))
                    own = list(zip(q["vec_id"].tolist(), q["copy"].tolist()))
                    for row, best in search_tree(tree, ids, copies, w, own, q["floor"].to_numpy(), k):
                        out += [(*own[row], -i, -j, s) for s, i, j in best]
            yield pd.DataFrame(out, columns=["query_id", "qcopy", "vec_id", "copy", "score"])

    return run


def route(boxes: dict, shards: list[list[int]], first: int, last: int | None):
    """A row for each shard that a query goes to: of those but its own, in order of bound, numbers first to last."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            take, to = [], []
            for row, (v, home, floor) in enumerate(zip(batch["v"], batch["shard"], batch["floor"])):
                leaves, low, high = boxes.get(len(v), ((), None, None))
                if not len(leaves):
                    continue
                q = np.asarray(v, np.float64)
                bound = np.maximum(q * low, q * high).sum(axis=1)
                bound = bound + np.abs(bound) * 1e-12  # of doubles that were rounded, none may be too low
                order = [s for k in np.argsort(-bound, kind="stable") for s in shards[leaves[k]] if s != home]
                fits = {s for k in np.flatnonzero(bound >= floor) for s in shards[leaves[k]]}
                chosen = [s for s in order[first:last] if s in fits]
                take += [row] * len(chosen)
                to += chosen
            out = batch.iloc[take].copy()
            out["shard"] = np.array(to, np.int32)
            yield out

    return run


def leaf_boxes(trees: DataFrame) -> DataFrame:
    """leaf, n, low, high: the box around all trees of a leaf."""
    ends = trees.where("n > 0").select("leaf", "n", F.posexplode(F.arrays_zip("low", "high")).alias("at", "x"))
    per = ends.groupBy("leaf", "n", "at").agg(F.min("x.low").alias("low"), F.max("x.high").alias("high"))
    side = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("at", c))), lambda x: x[c])
    some = per.groupBy("leaf", "n").agg(side("low").alias("low"), side("high").alias("high"))
    nothing = F.array().cast("array<long>")
    return some.unionByName(trees.where("n = 0").select("leaf", "n", nothing.alias("low"), nothing.alias("high")).distinct())


def search(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each vector whose id is divisible by ``every``."""
    vectors = cut(vectors)
    leaves = min(MOST_LEAVES, -(-vectors.count() // SHARD_ROWS))
    nodes: list[tuple[int, int]] = []
    if leaves > 1:
        sample = vectors.orderBy(F.xxhash64("vec_id", "copy"), "vec_id", "copy").limit(SAMPLE_ROWS).select("v").collect()
        longest = max(len(r["v"]) for r in sample)
        rows = np.array([r["v"] for r in sample if len(r["v"]) == longest], np.int64).reshape(-1, longest)
        nodes = splits(rows, (leaves - 1).bit_length()) if longest else []
    dealt = vectors.withColumn("leaf", leaf_of(F.col("v"), nodes))
    counts = {r["leaf"]: r["n"] for r in dealt.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # MOST_LEAVES rows
    parts = [max(1, -(-counts.get(i, 0) // SHARD_ROWS)) for i in range(len(nodes) + 1)]
    firsts = [sum(parts[:i]) for i in range(len(parts))]
    shards = [list(range(a, a + n)) for a, n in zip(firsts, parts)]
    numbers = lambda x: F.split(F.lit(",".join(map(str, x))), ",")
    salt = F.pmod(F.xxhash64("vec_id", "copy"), F.get(numbers(parts), F.col("leaf")).cast("long"))
    dealt = dealt.withColumn("shard", (F.get(numbers(firsts), F.col("leaf")).cast("long") + salt).cast("int"))

    trees = cut(dealt.select("shard", "leaf", "vec_id", "copy", "v").groupBy("shard").applyInPandas(build, "shard int, leaf int, n int, low array<long>, high array<long>, tree binary"))
    boxes: dict = {}
    for r in leaf_boxes(trees).collect():
        boxes.setdefault(r["n"], []).append(r)
    boxes = {n: ([r["leaf"] for r in own], np.array([r["low"] for r in own], np.float64).reshape(len(own), n), np.array([r["high"] for r in own], np.float64).reshape(len(own), n)) for n, own in boxes.items()}

    queries = dealt.where(F.col("vec_id") % every == 0)
    blocks = max(1, -(-queries.count() // QUERY_ROWS))
    block = F.pmod(F.xxhash64("copy", "vec_id", F.lit(3)), F.lit(blocks)).cast("int")
    queries = queries.select("shard", F.lit(1).alias("kind"), block.alias("block"), "vec_id", "copy", "v", F.lit(float("-inf")).alias("floor"), F.lit(None).cast("binary").alias("tree"))
    tree_rows = trees.select("shard", F.lit(0).alias("kind"), F.explode(F.array(*map(F.lit, range(blocks))) if blocks < 64 else F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(0).cast("long").alias("vec_id"), F.lit(0).alias("copy"), F.array().cast("array<long>").alias("v"), F.lit(0.0).alias("floor"), "tree")

    def answers(asked: DataFrame) -> DataFrame:
        met = tree_rows.unionByName(asked).repartition("shard", "block").sortWithinPartitions("shard", "block", "kind")
        return cut(met.mapInPandas(ask(k), _PAIR))

    found = answers(queries)
    for first, last in ((0, NEXT), (NEXT, None)) if sum(parts) > 1 else ():
        floors = found.groupBy("query_id", "qcopy").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s"))
        floors = floors.select("query_id", "qcopy", F.get("s", F.lit(k - 1)).cast("double").alias("kth"))
        asked = queries.drop("floor").join(floors, (F.col("vec_id") == F.col("query_id")) & (F.col("copy") == F.col("qcopy")), "left")
        asked = asked.withColumn("floor", F.coalesce("kth", F.lit(float("-inf")))).select(*queries.columns)
        found = found.unionByName(answers(asked.mapInPandas(route(boxes, shards, first, last), _ASKED)))
    order = Window.partitionBy("query_id", "qcopy").orderBy(F.desc("score"), "vec_id", "copy")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
