"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, in DataFrame functions only.

Every source is one endless-looking stream of words: its documents in an order given by a hash, laid end to
end, twice.  A mix draws the first ``target`` words of each stream, cut into equal blocks, so a source's
exact block quota is known before any document moves.  The quotas are split among the output shards by a
binary tree: at each node the left half of the shards receives a multivariate-hypergeometric sample of the
node's quotas (selection sampling over the units, driven by a hash).  The blocks of a source are permuted by a
seeded hash, and a shard owns a run of the permuted blocks, disjoint from all others, and orders its own pieces
by a hash.  Tables of sources and blocks have a row or entry per source and at most SHARDS * BLOCKS_PER_SHARD more.

Defined results: null text has size 0; null source is a source of its own, ordered last; null or repeated
doc_id are rows like any other; documents of no words are taken 0 times; an empty table gives no rows;
columns beyond doc_id, source and text are ignored.  At most one document per source and pass is cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, gathered, let, words

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST = 1.5, 2.0
SHARDS, BLOCKS_PER_SHARD = 64, 128
#: Rows of a source that one window task orders: the number of hash ranges follows the number of rows.
RANGE_ROWS = 4_000
#: The plan goes to all tasks up to this many sources (its blocks are bounded anyway).
BROADCAST_SOURCES = 100_000
#: Bits of the digest that orders a stream.
KEY_BITS = 60


def _digest(*parts) -> Column:
    """A number of KEY_BITS bits from a digest of the parts, which any engine with MD5 can compute."""
    text = F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("-")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, KEY_BITS // 4), 16, 10).cast("long")


def _unit(*parts) -> Column:
    """A number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / F.lit(float(1 << 53))


def sizes(documents: DataFrame, seed: int = 7, carry: bool = False) -> DataFrame:
    """doc_id, source, size and the key that orders a source's stream; with ``carry`` the whole row as ``doc``."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)).cast("long"), F.lit(0).cast("long"))
    row = [F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("doc")] if carry else []
    return documents.select("doc_id", "source", size.alias("size"), _digest(F.lit(seed), F.col("doc_id"), F.md5(F.coalesce("text", F.lit("")))).alias("key"), *row)


def targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row per source: source, number (by code point, null last), source_size, target.

    ``target = min(most * size, weight * level)`` with the one level at which targets sum to the share: it is
    where sharing out the excess again and again ends.  The windows run over one row per source.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    number = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("number") - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("number", number).withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "number")
    below = order.rowsBetween(Window.unboundedPreceding, -1)
    above = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    want = share * F.sum("source_size").over(whole)
    per = per.withColumn("level", (want - F.coalesce(F.sum("cap").over(below), F.lit(0.0))) / F.sum("weight").over(above))
    free = F.when(F.col("cap") / F.col("weight") > F.col("level"), F.struct(F.col("cap") / F.col("weight"), F.col("number"), F.col("level").alias("level")))
    per = per.withColumn("level", F.min(free).over(whole)["level"])
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.col("level")))
    return per.select("source", "number", "source_size", target.alias("target"))


def split_quotas(quotas: DataFrame, shards: int, seed: int = 7) -> DataFrame:
    """Split exact quotas (number, quota) among shards: number, ends (cumulative blocks after each shard).

    The tree holds one row per node with one entry per source; its depth is log2(shards) and a level costs
    one hash per block.
    """
    node = quotas.select(F.struct("number", F.col("quota").cast("long").alias("quota")).alias("q")).agg(F.array_sort(F.collect_list("q")).alias("qs"))
    node = node.where(F.size("qs") > 0).select(F.lit(0).alias("lo"), F.lit(shards).alias("hi"), F.transform("qs", lambda q: q["quota"]).alias("a"), F.transform("qs", lambda q: q["number"]).alias("numbers"))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    depth = max(0, (shards - 1).bit_length())
    for _ in range(depth):
        node = node.withColumn("mid", F.expr("lo + (hi - lo) div 2")).withColumn("n", total(F.col("a")))
        draws = F.floor(F.col("n") * (F.col("mid") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1))).cast("long")

        def source(acc: Column, x: Column) -> Column:
            """Take or leave each unit of one source; the odds are the draws left over the units left."""
            at = F.size(acc["left"])
            units = F.when(x["q"] > 0, F.sequence(F.lit(1).cast("long"), x["q"])).otherwise(F.array().cast("array<long>"))

            def unit(s: Column, i: Column) -> Column:
                hit = (_unit(F.lit(seed), F.col("lo"), F.col("hi"), at, i) * s["u"] < s["d"]).cast("long")
                return F.struct((s["d"] - hit).alias("d"), (s["u"] - 1).alias("u"), (s["x"] + hit).alias("x"))

            start = F.struct(acc["d"].alias("d"), acc["u"].alias("u"), F.lit(0).cast("long").alias("x"))
            return let(F.aggregate(units, start, unit), lambda r: F.struct(r["d"].alias("d"), r["u"].alias("u"), F.concat(acc["left"], F.array(r["x"])).alias("left")))

        zero = F.struct(draws.alias("d"), F.col("n").alias("u"), F.array().cast("array<long>").alias("left"))
        left = F.aggregate(F.transform("a", lambda q: F.struct(q.alias("q"))), zero, source, lambda acc: acc["left"])
        node = node.withColumn("left", left)
        right = F.zip_with("a", "left", lambda a, b: a - b)
        halves = F.array(F.struct(F.col("lo").alias("lo"), F.col("mid").alias("hi"), F.col("left").alias("a")), F.struct(F.col("mid").alias("lo"), F.col("hi").alias("hi"), right.alias("a")))
        node = node.select("numbers", F.explode(halves).alias("h")).select("numbers", "h.*").where("hi > lo")
    per = node.select(F.col("lo").alias("shard"), F.explode(F.arrays_zip("numbers", "a")).alias("z")).select("shard", F.col("z.numbers").alias("number"), F.col("z.a").alias("n"))
    ends = per.groupBy("number").agg(F.array_sort(F.collect_list(F.struct("shard", "n"))).alias("s"))
    running = F.aggregate("s", F.array().cast("array<long>"), lambda acc, x: F.concat(acc, F.array(x["n"] + F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0).cast("long")))))
    return ends.select("number", running.alias("ends"))


def block_shards(number: Column, quota: Column, ends: Column, seed: int) -> Column:
    """(block, shard) for each block of a source: blocks in the order of a seeded digest fill the shards in turn."""
    blocks = F.when(quota > 0, F.sequence(F.lit(0).cast("long"), quota - 1)).otherwise(F.array().cast("array<long>"))
    permuted = F.array_sort(F.transform(blocks, lambda b: F.struct(F.xxhash64(F.lit(seed), number, b).alias("h"), b.alias("b"))))
    return F.transform(permuted, lambda x, place: F.struct(x["b"].alias("block"), F.size(F.filter(ends, lambda e: e <= place)).alias("shard")))


def draw(documents: DataFrame, shards: int = SHARDS, blocks_per_shard: int = BLOCKS_PER_SHARD, seed: int = 7, carry: bool = False) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, key, pieces (and doc, with ``carry``).

    ``pieces`` are the drawn parts of the document: pass (0 or 1), first and last word (end exclusive), shard.
    """
    documents = gathered(documents)
    sized = cut(sizes(documents, seed))
    per = cut(targets(sized), 1)
    drawn = per.withColumn("draw", F.round("target").cast("long"))
    words_drawn = drawn.agg(F.sum("draw")).first()[0] or 0
    drawn = drawn.withColumn("block", F.lit(max(1, -(-words_drawn // (shards * blocks_per_shard)))).cast("long"))
    drawn = drawn.withColumn("quota", F.ceil(F.col("draw") / F.col("block")).cast("long"))
    drawn = cut(drawn.join(split_quotas(drawn.select("number", "quota"), shards, seed), "number", "left"), 1)

    shards_of = drawn.select("number", F.explode(block_shards(F.col("number"), F.col("quota"), F.col("ends"), seed)).alias("x"))
    shards_of = shards_of.groupBy("number").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["shard"]).alias("shards"))
    # One entry per block, and so at most shards * blocks_per_shard entries and one per source
    plan = drawn.drop("ends").join(shards_of, "number", "left").select(F.col("source").alias("s2"), "source_size", "target", "draw", "block", "shards")
    plan = cut(plan, 1)

    ranges = max(1, -(-sized.count() // RANGE_ROWS))
    placing = lambda df: df.withColumn("range", F.floor(F.col("key").cast("double") * ranges / float(1 << KEY_BITS)).cast("long"))
    ranged = placing(sized)
    sums = ranged.groupBy("source", "range").agg(F.sum("size").alias("words"))
    before = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    sums = sums.select(F.col("source").alias("s"), F.col("range").alias("r"), before.alias("before"))
    if plan.count() <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    inside = F.coalesce(F.sum("size").over(Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    placed = (placing(sizes(documents, seed, carry)) if carry else ranged).withColumn("inside", inside).join(sums, F.expr("source <=> s and range = r")).join(plan, F.expr("source <=> s2")).withColumn("start", F.col("before") + F.col("inside"))

    def of_pass(p: int) -> Column:
        start = F.col("start") + p * F.col("source_size")
        end = F.least(start + F.col("size"), F.col("draw"))
        blocks = F.when(end > start, F.sequence(F.floor(start / F.col("block")), F.floor((end - 1) / F.col("block")))).otherwise(F.array().cast("array<long>"))

        def piece(b: Column) -> Column:
            return F.struct(
                F.lit(p).alias("pass"),
                (F.greatest(b * F.col("block"), start) - start).alias("from_word"),
                (F.least((b + 1) * F.col("block"), end) - start).alias("to_word"),
                F.get("shards", b.cast("int")).alias("shard"),
            )

        return F.transform(blocks, piece)

    return placed.select("doc_id", "source", "size", "source_size", "target", "key", F.concat(of_pass(0), of_pass(1)).alias("pieces"), *(["doc"] if carry else []))


def taken(pieces: Column) -> Column:
    return F.aggregate(pieces, F.lit(0).cast("long"), lambda n, p: n + p["to_word"] - p["from_word"])


def mix(documents: DataFrame, shards: int = SHARDS, seed: int = 7) -> DataFrame:
    """The mixed documents, with the columns of ``documents``: a row for each pass over a document that is taken.

    A pass that takes a part of a document keeps that part's words, joined by single spaces.  Rows lie in the
    shard of their first block, in an order given by a hash.
    """
    first, second = F.filter("pieces", lambda x: x["pass"] == 0), F.filter("pieces", lambda x: x["pass"] == 1)
    own = F.explode(F.array(first, second)).alias("own")
    copies = draw(documents, shards, seed=seed, carry=True).where(F.size("pieces") > 0).select("size", "key", "doc", own).where(F.size("own") > 0)
    copies = copies.select("doc", "size", "key", F.element_at("own", 1)["from_word"].alias("lo"), F.element_at("own", -1)["to_word"].alias("hi"), F.element_at("own", 1)["shard"].alias("shard"), F.element_at("own", 1)["pass"].alias("pass"))
    part = F.array_join(F.slice(words(F.col("doc")["text"]), (F.col("lo") + 1).cast("int"), (F.col("hi") - F.col("lo")).cast("int")), " ")
    text = F.when(F.col("hi") - F.col("lo") == F.col("size"), F.col("doc")["text"]).otherwise(part)
    columns = [text.alias(c) if c == "text" else F.col("doc")[c].alias(c) for c in documents.columns]
    order = F.xxhash64(F.lit(seed), "key", "pass")
    return copies.repartition("shard").sortWithinPartitions("shard", order).select(*columns)
