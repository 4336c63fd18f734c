"""Near duplicates by SetSketch registers: band, estimate, verify on full sets, connect.

Each document is the set of its distinct word shingles (64-bit fingerprints).  Its sketch has REGISTERS
registers: for each, the least of the exponentially distributed hashes of its shingles, kept as the truncated
power of BASE, so that sketches merge by maximum and equal registers become likelier with resemblance.

1. Documents of equal sets are one class; only classes go on.
2. Bands of ROWS registers put classes into buckets.  A pair of resemblance 0.85 shares no bucket with
   probability (1 - 0.85 ** 5) ** 30 = 2e-8.
3. Each class is compared with a few bucket centres, drawn by a hash, on full sets.  Links connect components.
4. Buckets that still hold several components are compared in full: pairs of different components that the
   joint likelihood of their registers leaves possible are verified on full sets.  Large buckets are dealt into
   chunks and compared chunk by chunk, so that a group holds about 2 * CHUNK classes and 2 * CHUNK_SHINGLES
   shingles at most.
5. Links of both steps connect the final components by contraction to least neighbours.

All pairs of a group are never made: copies share a class, and classes of one component are not compared
again.  Texts are read twice; the second time only those of classes that need comparing are kept.

Defined results: null and empty texts have no shingles and are linked with nothing; a text under the shingle
length is one shingle; null doc_id is a row of its own, never the least id; a group of null ids only has no
component id and all of it is kept; repeated rows share a class; columns other than doc_id and text are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, gathered, give_back, id_text, tasks_for

ROWS, BANDS, BASE, RATE = 5, 30, 1.02, 20.0
REGISTERS = ROWS * BANDS
#: Bucket centres that a class is compared with in step 3; classes and shingles of one chunk in step 4.
CENTRES, CHUNK, CHUNK_SHINGLES = 3, 2_048, 2_000_000
#: Step 4 leaves out pairs whose registers are exp(14) times likelier under a smaller resemblance.
LEAST_LOG_RATIO = 14.0
#: After a group of so many shingles a worker gives its free memory back.
BIG_GROUP = 500_000
#: Up to this many ids (16 MB) go to all tasks when texts are read again; above it the tables are joined by id.
BROADCAST_IDS = 1_000_000


def shingle_sets(texts, width: int) -> Iterator[np.ndarray]:
    """Of each text, the sorted distinct fingerprints of its shingles.

    Words are hashed for many texts at once; bytes.split() and lower() treat ASCII only.
    """
    words: list[bytes] = []
    lens: list[int] = []

    def flush():
        items = np.empty(len(words), object)
        items[:] = words
        w, at = pd.util.hash_array(items, categorize=False), 0
        for n in lens:
            yield _shingles(w[at : at + n], width)
            at += n

    for text in texts:
        own = text.encode().lower().split() if isinstance(text, str) else []
        words += own
        lens.append(len(own))
        if len(words) >= 300_000:
            yield from flush()
            words, lens = [], []
    yield from flush()


def _shingles(w: np.ndarray, width: int) -> np.ndarray:
    if not len(w):
        return np.zeros(0, np.uint64)
    n = max(1, len(w) - width + 1)
    h = np.full(n, 0x9E3779B97F4A7C15 * min(len(w), width) & (2**64 - 1), np.uint64)
    for k in range(min(width, len(w))):
        h = (h ^ w[k : k + n]) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    return np.unique(h)


_SEEDS = np.random.Generator(np.random.PCG64(8)).integers(0, 2**63, (2, REGISTERS), dtype=np.uint64)
_XOR, _TIMES = _SEEDS[0], _SEEDS[1] * np.uint64(2) + np.uint64(1)


def registers(h: np.ndarray) -> np.ndarray:
    """floor(1 - log_BASE(x)) of the least exponential variate x of each register, truncated to 16 bits."""
    least = np.full(REGISTERS, 2**64 - 1, np.uint64)
    for a in range(0, len(h), 1024):
        x = (h[a : a + 1024, None] ^ _XOR) * _TIMES
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        least = np.minimum(least, x.min(axis=0))
    u = (least.astype(np.float64) + 0.5) / 2.0**64
    return np.clip(np.floor(1 - np.log(-np.log1p(-u) / RATE) / np.log(BASE)), 0, 65535).astype(np.uint16)


def log_ratios(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, least: float) -> np.ndarray:
    """For pairs of rows: how much likelier (in logarithms) the registers are under a resemblance below ``least`` than at it."""
    up, down = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - up - down
    u, v = na / (na + nb), nb / (na + nb)

    def likelihood(j):
        j = np.minimum(j, np.minimum(u / v, v / u) - 1e-9)
        p = lambda x: -np.log1p(-np.clip(x, 1e-9, 1) * (BASE - 1) / BASE) / np.log(BASE)
        more, less = p(u - v * j), p(v - u * j)
        return up * np.log(more) + down * np.log(less) + same * np.log(np.clip(1 - more - less, 1e-9, 1))

    at = likelihood(np.full(len(nb), least))
    best = np.max([likelihood(np.full(len(nb), j)) for j in np.arange(0.02, least, 0.04)], axis=0)
    return best - at


def sketches(documents: DataFrame, width: int, own: Column) -> DataFrame:
    """doc_id, own, n, node (digest of the set), sketch; node and sketch are null for an empty set."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n, node, regs = [], [], []
            for h in shingle_sets(batch["text"], width):
                n.append(len(h))
                node.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest() if len(h) else None)
                regs.append(registers(h).tobytes() if len(h) else None)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "own": batch["own"], "n": n, "node": node, "sketch": regs})
        give_back()

    made = documents.select(id_text(), "text", own.alias("own")).mapInPandas(run, "doc_id string, own binary, n long, node binary, sketch binary")
    return made.withColumn("doc_id", F.col("doc_id").cast("long"))


def full_sets(documents: DataFrame, width: int) -> DataFrame:
    """node, n and fingerprints of each document of a set."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [h for h in shingle_sets(batch["text"], width) if len(h)]
            if not sets:
                continue  # an empty column of lists has no type
            yield pd.DataFrame({"node": [hashlib.blake2b(h.tobytes(), digest_size=16).digest() for h in sets], "shingles": [h.view(np.int64) for h in sets]})
        give_back()

    return documents.select("text").mapInPandas(run, "node binary, shingles array<long>")


def components(edges: DataFrame, most: int) -> DataFrame:
    """node, label for each node of an edge (a, b): the same label in a component, by contraction; edges: at most ``most``.

    In each round every node goes to its least neighbour, twice; edges follow and loops vanish.  A node's least
    neighbour is at the other end of an edge, so the image of a component stays connected.  Nodes are digests, so
    their order is random and the number of rounds logarithmic.
    """
    edges = edges.select("a", "b").where("a <> b").distinct()
    edges, left = cut(edges, most), None
    labels = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct().withColumn("label", F.col("node"))
    while left != 0:
        left = edges.count()
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("x"), F.least("a", "m").alias("p"))
        twice = parent.join(parent.select(F.col("x").alias("y"), F.col("p").alias("pp")), F.col("p") == F.col("y")).select("x", F.col("pp").alias("p"))
        twice = cut(twice, 2 * left)
        labels = labels.join(twice, F.col("label") == F.col("x"), "left").select("node", F.coalesce("p", "label").alias("label"))
        moved = edges.join(twice.select(F.col("x").alias("a"), F.col("p").alias("pa")), "a").join(twice.select(F.col("x").alias("b"), F.col("p").alias("pb")), "b")
        edges = cut(moved.where("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct(), left)
        left = 0 if edges.isEmpty() else left
    return cut(labels, 2 * most)


def _agree(a: Column, b: Column, percent: int) -> Column:
    both = F.size(F.array_intersect(a, b))
    return 100 * both >= percent * (F.size(a) + F.size(b) - both)


def possible(percent: int):
    """Of one bucket (or a pair of its chunks), the classes with a possible partner in another component."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        comp = pd.factorize(rows["comp"])[0]
        keep = np.zeros(len(rows), bool)
        if comp.max(initial=0) > 0:
            sketch = np.frombuffer(b"".join(rows["sketch"]), np.uint16).reshape(len(rows), REGISTERS)
            n = rows["n"].to_numpy()
            step = max(1, 20_000 // len(rows))  # so many rows against all at once
            for a in range(0, len(rows), step):
                i, j = np.nonzero((comp[a : a + step, None] != comp) & (100 * np.minimum(n[a : a + step, None], n) >= percent * np.maximum(n[a : a + step, None], n)))
                i += a
                i, j = i[i < j], j[i < j]
                # With under half of the registers alike the ratio is far beyond the limit; most pairs end here.
                alike = (sketch[i] == sketch[j]).sum(axis=1) * 2 >= REGISTERS
                i, j = i[alike], j[alike]
                if len(i):
                    near = log_ratios(sketch[i], sketch[j], n[i], n[j], percent / 100) <= LEAST_LOG_RATIO
                    keep[i[near]] = keep[j[near]] = True
        return rows.loc[keep, ["group", "node", "comp"]]

    return run


def linked(percent: int):
    """Links between components in one group, on full sets; once two components are joined they count as one."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        sets = [np.asarray(s, np.int64) for s in rows["shingles"]]
        node, comp = rows["node"].tolist(), pd.factorize(rows["comp"])[0]
        size = np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(len(sets)), size)
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        out = []
        # Fixed before any join: each link has an end outside the component that is the largest at first.
        outside = np.flatnonzero(comp != np.bincount(comp).argmax())
        for i in outside:
            low, high = np.searchsorted(flat, sets[i], "left"), np.searchsorted(flat, sets[i], "right")
            span = high - low
            at = np.repeat(high - np.cumsum(span), span) + np.arange(span.sum())
            both = np.bincount(owner[at], minlength=len(sets))
            for j in np.flatnonzero((100 * both >= percent * (size + size[i] - both)) & (comp != comp[i])):
                if comp[j] != comp[i]:
                    out.append((node[i], node[j]))
                    comp[comp == comp[j]] = comp[i]
        if len(flat) > BIG_GROUP:
            del sets, flat, owner, order
            give_back()
        return pd.DataFrame(out, columns=["a", "b"])

    return run


def group(documents: DataFrame, width: int = 3, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per document."""
    out = _grouped(documents, width, percent, F.lit(None).cast("binary"))
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))


def _grouped(documents: DataFrame, width: int, percent: int, own: Column) -> DataFrame:
    """doc_id, own, n, node, label (of the component), component_id: one row per document."""
    documents = gathered(documents)
    rows = cut(sketches(documents, width, own))
    classes = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = cut(classes, rows.count())
    size = classes.count()
    band = lambda b: F.xxhash64(b, F.substring(F.col("sketch"), b * (2 * ROWS) + 1, F.lit(2 * ROWS)))
    spread = classes.select("node", "n", F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), band)).alias("key"))
    drawn = F.min(F.struct(F.xxhash64("key", "node").alias("h"), F.col("node").alias("centre")))
    buckets = spread.groupBy("key").agg(drawn.alias("c"), F.count("*").alias("members"), F.sum("n").alias("total")).where("members > 1")
    chunks = F.greatest(F.ceil(F.col("members") / F.lit(CHUNK)), F.ceil(F.col("total") / F.lit(CHUNK_SHINGLES)))
    buckets = buckets.select("key", chunks.alias("chunks"), F.col("c.centre").alias("centre"))
    shared = cut(spread.drop("n").join(buckets, "key"), BANDS * size)

    # Step 3: each class against the centres with which it shares most buckets
    met = shared.where("node <> centre").groupBy("node", "centre").agg(F.count("*").alias("times"))
    first = Window.partitionBy("node").orderBy(F.desc("times"), "centre")
    tries = cut(met.withColumn("k", F.row_number().over(first)).where(F.col("k") <= CENTRES).select("node", "centre"), CENTRES * size)
    sets = _sets(documents, classes, size, shared.select("node").distinct(), width)
    left = tries.join(sets.select("node", F.col("shingles").alias("s1")), "node")
    checked = left.join(sets.select(F.col("node").alias("centre"), F.col("shingles").alias("s2")), "centre")
    edges = cut(checked.where(_agree(F.col("s1"), F.col("s2"), percent)).select(F.col("node").alias("a"), F.col("centre").alias("b")), CENTRES * size)

    # Step 4: buckets that still hold several components
    labels = components(edges, CENTRES * size)
    placed = shared.select("key", "node", "chunks").join(labels, "node", "left").withColumn("comp", F.coalesce("label", "node"))
    mixed = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    own = F.pmod(F.xxhash64("node"), F.col("chunks"))
    pair = F.transform(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), lambda c: F.xxhash64("key", F.least(c, own), F.greatest(c, own)))
    members = placed.join(mixed, "key").select("node", "comp", F.explode(pair).alias("group"))
    parts, parts_most = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), tasks_for(documents)
    sketched = members.join(classes.select("node", "n", "sketch"), "node").repartition(parts, "group")  # by work, not by bytes
    may = cut(sketched.groupBy("group").applyInPandas(possible(percent), "group long, node binary, comp binary").coalesce(parts_most))
    more = may.join(sets, "node").groupBy("group").applyInPandas(linked(percent), "a binary, b binary")
    labels = components(edges.unionByName(more), CENTRES * size)

    # Step 5: the least id of each component
    known = classes.select("node", "rep").join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"), "rep")
    least = known.groupBy("label").agg(F.min("rep").alias("component_id"))
    ids = known.join(least, "label").select("node", "label", "component_id")
    # Rows without a set have no class; they would all meet at the null key of the join.
    alone = rows.where("node is null").select("node", "doc_id", "own", "n", F.lit(None).cast("binary").alias("label"), F.lit(None).cast("long").alias("component_id"))
    return rows.where("node is not null").select("doc_id", "own", "n", "node").join(ids, "node").select(alone.columns).unionByName(alone)


def _sets(documents: DataFrame, classes: DataFrame, size: int, nodes: DataFrame, width: int) -> DataFrame:
    """node, shingles of the given classes, from the texts of their least documents (of all documents without id)."""
    need = cut(classes.join(nodes, "node").select("node", "rep"), size)
    ids = need.where("rep is not null").select(F.col("rep").alias("doc_id")).distinct()
    many = need.count()
    if many <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    texts = documents.select("doc_id", "text").join(ids, "doc_id", "left_semi")
    if not need.where("rep is null").isEmpty():
        texts = texts.unionByName(documents.select("doc_id", "text").where("doc_id is null"))
    return cut(full_sets(texts, width).join(need.select("node"), "node", "left_semi").dropDuplicates(["node"]), 8 * many)


def keep_one(documents: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group: that of its least id, and of its least digest among rows of this id or of null ids only.

    Rows alike in id and text are told apart by their other columns, and one is kept.  Null ids come last.  Rows
    without shingles are linked with nothing and all kept.
    """
    digest = F.unhex(F.md5(F.coalesce("text", F.lit(""))))
    rows = cut(_grouped(documents, width, percent, digest).coalesce(tasks_for(documents)))
    texts = rows.where("node is not null").groupBy("label", "doc_id", "own").agg(F.count("*").alias("times"))
    least = texts.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "own", "times")).alias("f"))
    alone = rows.where("node is null").select("doc_id", "own", F.lit(False).alias("tied")).distinct()
    kept = cut(least.select("f.doc_id", "f.own", (F.col("f.times") > 1).alias("tied")).unionByName(alone).coalesce(tasks_for(documents))).withColumnRenamed("doc_id", "id")
    whole = documents.select(F.struct(*documents.columns).alias("document"), F.col("doc_id").alias("doc"), digest.alias("digest"))
    met = lambda k: whole.join(k, F.col("doc").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("own")), "left_semi")
    out = met(kept.where("not tied")).select("document.*")
    tied = kept.where("tied")
    if not tied.isEmpty():
        first = Window.partitionBy("doc", "digest").orderBy(F.to_json("document"))
        out = out.unionByName(met(tied).withColumn("k", F.row_number().over(first)).where("k = 1").select("document.*"))
    return out.coalesce(tasks_for(documents))
