"""Language-model scores by Katz backoff of any order, with Good-Turing discounts and exact backoff weights.

Tokens are words, then one end; a start stands before each text, and histories don't reach beyond it.  Counts come
from the documents that may be learned from.  P(w | h) is the discounted share of the n-gram hw where it was seen,
else a(h) * P(w | h without its first word), and so on down to P(w): the discounted share of the word, where what
the discounts leave over is the chance of any unknown word.  a(h) is the mass that h's discounts leave, over the
mass, at the next lower order, of words not seen after h, so each history sums to one; of a history never seen it is one.

Tables are dealt by hash, one table for each length of n-gram, and a block of documents speaks to them in sorted
arrays of 64-bit fingerprints, one row per block and part, so that a frequent n-gram is one entry per block:

1. n-grams, one length after another: blocks send fingerprints, counts and which of them held-out documents have;
   the part returns the counts over all blocks, and gives each n-gram one block as its owner;
2. blocks score their documents token by token down the orders: what needs no weight at once; owners send, per
   history that held-out documents have, the left-over mass and the mass of its seen words;
3. histories: the part sums them and returns the weights that blocks wait for, which then join their scores.

Blocks are cut alike in each pass and named by their content and place (partition, number in the partition), so
that blocks of the same rows stay apart; a block that misses its counts stops the job.

Defined results: null text is empty: its only token is the end; null doc_id is learned from and not held out;
repeated rows count and are scored each; an empty table gives no rows; with nothing to learn from, scores are
those of unknown words; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_shuffles, gathered, give_back, id_text, partition, parts_for

#: Tokens of a block, which bounds the memory of a task.
BLOCK_TOKENS = 1_500_000
#: Counts up to TOP are discounted by Good-Turing, those above by SPARE in all, so that each history has mass left.
TOP, SPARE = 5, 1e-3
END, START = b" ", b"\t"  # no word holds white space

_SENT = "block long, part int, payload binary"
_WEIGHED = "block long, level int, part int, payload binary"
_COUNTED = _SENT + ", tokens long, types long, n1 long, n2 long, n3 long, n4 long, n5 long, n6 long"
_SCORED = "block long, level int, part int, doc_id string, n_tokens long, n_known long, base double, score double, payload binary"


def fingerprints(words: list[bytes]) -> np.ndarray:
    """64-bit fingerprints of words, all at once."""
    items = np.empty(len(words), object)
    items[:] = words
    return pd.util.hash_array(items, categorize=False)


def pack(values: np.ndarray, rising: bool = False) -> bytes:
    """64-bit integers by planes of their bytes, compressed; rising ones as differences."""
    v = np.ascontiguousarray(values).view(np.uint64)
    if rising and len(v):
        v = np.concatenate((v[:1], np.diff(v)))
    return zlib.compress(v.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpack(raw: bytes, rising: bool = False, kind=np.uint64) -> np.ndarray:
    v = np.ascontiguousarray(np.frombuffer(zlib.decompress(raw), np.uint8).reshape(8, -1).T).view(np.uint64).ravel()
    return (np.cumsum(v, dtype=np.uint64) if rising else v).view(kind)


def pack_bits(values: np.ndarray) -> bytes:
    return zlib.compress(np.packbits(values).tobytes(), 1)


def unpack_bits(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(raw), np.uint8))[:n].astype(bool)


def bundle(*parts: bytes) -> bytes:
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def unbundle(raw: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(raw):
        n = int.from_bytes(raw[at : at + 8], "little")
        out.append(raw[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def held_out(doc_id) -> bool:
    """Of a doc_id or its text."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


class Block:
    """Documents of one block: ``flat`` holds start, words, end of each, as fingerprints."""

    def __init__(self, ids: list, lens: list[int], words: list[bytes], place: tuple[int, int]):
        self.ids = ids
        self.lens = np.array(lens, np.int64)
        self.flat = fingerprints(words)
        self.train = np.array([not held_out(i) for i in ids])
        digest = hashlib.blake2b(repr((place, ids)).encode() + self.flat.tobytes(), digest_size=8)
        self.name = int.from_bytes(digest.digest(), "little", signed=True)

    def documents(self) -> np.ndarray:
        """The document of each place in ``flat``."""
        return np.repeat(np.arange(len(self.ids)), self.lens)

    def grams(self, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For n up to ``order``: the places in ``flat`` where an n-gram ends (n = 1: all) and the n-grams' keys."""
        offset = np.arange(len(self.flat)) - np.repeat(np.cumsum(self.lens) - self.lens, self.lens)
        at, keys = np.arange(len(self.flat)), self.flat
        for n in range(1, order + 1):
            if n > 1:
                inner = np.flatnonzero(offset[at] >= n - 1)  # their predecessors end an (n-1)-gram one entry before
                keys = extended(keys[inner - 1], self.flat[at[inner]])
                at = at[inner]
            yield at, keys

    def table(self, at: np.ndarray, keys: np.ndarray, parts: int):
        """Distinct keys by part, then value; the part of each; where each key stands among them; their counts in
        training documents; which of them held-out documents have."""
        distinct, where = np.unique(keys, return_inverse=True)
        part = (distinct % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        of_train = np.repeat(self.train, self.lens)[at]
        counts = np.bincount(where, of_train, len(distinct)).astype(np.int64)
        wanted = np.bincount(where, ~of_train, len(distinct)) > 0
        return distinct[order], part[order], place[where], counts[order], wanted[order]


def extended(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Keys of histories with a word more."""
    x = (history * np.uint64(0x9E3779B97F4A7C15) ^ (word >> np.uint64(29))) + word * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(30)
    return x * np.uint64(0x94D049BB133111EB)


def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[Block]:
    ids, lens, words, own_partition, number = [], [], [], partition(), 0
    for batch in batches:
        for i, text in zip(batch["doc_id"], batch["text"]):
            own = text.encode().lower().split() if isinstance(text, str) else []
            words.append(START)
            words += own
            words.append(END)
            lens.append(len(own) + 2)
            ids.append(i)
            if len(words) >= BLOCK_TOKENS:
                yield Block(ids, lens, words, (own_partition, number))
                ids, lens, words, number = [], [], [], number + 1
    if ids:
        yield Block(ids, lens, words, (own_partition, number))


def send(parts: int, n: int):
    """Each block's n-grams, by part."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in blocks(batches):
            for at, found in b.grams(n):
                pass
            keys, part, _, counts, wanted = b.table(at, found, parts)
            edge = np.searchsorted(part, np.arange(parts + 1))
            cuts = [(p, slice(edge[p], edge[p + 1])) for p in range(parts) if edge[p] < edge[p + 1]]
            rows = [(b.name, p, bundle(pack(keys[c], True), pack(counts[c]), pack_bits(wanted[c]))) for p, c in cuts]
            yield pd.DataFrame(rows, columns=["block", "part", "payload"])
        give_back()

    return run


def count_part(n: int, order: int):
    """Counts over all blocks of the n-grams of one part, returned in each block's order; with owners, where n-grams
    have a history, and with numbers and what held-out documents have, where they are histories."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        sent = []
        for p in rows["payload"]:
            keys, counts, wanted = unbundle(p)
            keys = unpack(keys, True)
            sent.append((keys, unpack(counts, kind=np.int64), unpack_bits(wanted, len(keys))))
        keys, where = np.unique(np.concatenate([s[0] for s in sent]), return_inverse=True)
        counts = np.bincount(where, np.concatenate([s[1] for s in sent]).astype(float), len(keys)).astype(np.int64)
        wanted = np.bincount(where, np.concatenate([s[2] for s in sent]), len(keys)) > 0
        owner = np.zeros(len(where), bool)
        owner[np.unique(where, return_index=True)[1]] = True
        real = counts[(keys != fingerprints([START])[0]) & (counts > 0)]
        stats = (int(real.sum()), len(real), *(int((real == r).sum()) for r in range(1, TOP + 2)))
        out, at = [], 0
        for k, (block, part, s) in enumerate(zip(rows["block"], rows["part"], sent)):
            own = where[at : at + len(s[0])]
            parcel = [pack(counts[own])]
            parcel += [pack_bits(owner[at : at + len(own)])] if n > 1 else [b""]
            parcel += [pack(own.astype(np.int64), True), pack_bits(wanted[own])] if n < order else [b"", b""]
            out.append((block, part, bundle(*parcel), *(stats if k == 0 else (0,) * 8)))
            at += len(own)
        return pd.DataFrame(out, columns=["block", "part", "payload", "tokens", "types", *(f"n{r}" for r in range(1, 7))])

    return run


class Counted:
    """What the parts returned of a block's n-grams of one length, in the order of the block's table."""

    def __init__(self, rows: pd.DataFrame):
        self.counts, self.owner, self.number, self.wanted = (np.empty(0, t) for t in (np.int64, bool, np.int64, bool))
        parcels = [unbundle(p) for p in rows.sort_values("part")["payload"]]
        if parcels:
            counts = [unpack(x[0], kind=np.int64) for x in parcels]
            self.counts = np.concatenate(counts)
            if parcels[0][1]:
                self.owner = np.concatenate([unpack_bits(x[1], len(c)) for x, c in zip(parcels, counts)])
            if parcels[0][2]:
                self.number = np.concatenate([unpack(x[2], True, np.int64) for x in parcels])
                self.wanted = np.concatenate([unpack_bits(x[3], len(c)) for x, c in zip(parcels, counts)])


def discounts(n: list[int]) -> np.ndarray:
    """d[r] for r up to TOP by Good-Turing in Katz's form; absolute where the counts of counts don't allow it."""
    absolute = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
    d = np.array([1.0, *(1 - min(absolute, 0.9) / r for r in range(1, TOP + 1))])
    if n[0]:
        limit = (TOP + 1) * n[TOP] / n[0]
        for r in range(1, TOP + 1):
            if n[r - 1] and limit != 1:
                x = ((r + 1) * n[r] / n[r - 1] / r - limit) / (1 - limit)
                if 0.05 < x < 1:
                    d[r] = x
    return d


def discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    return np.where(counts <= TOP, d[np.minimum(counts, TOP)] * counts, np.maximum(counts - SPARE, 0.0))


def documents_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A block's documents: ids, lengths, distinct fingerprints and the place of each token's among them."""
    for b in blocks(batches):
        distinct, where = np.unique(b.flat, return_inverse=True)
        order = np.argsort(-np.bincount(where), kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        ids = zlib.compress("\n".join(i or "" for i in b.ids).encode(), 1)
        yield pd.DataFrame({"block": [b.name], "part": [-1], "payload": [bundle(ids, pack(b.lens), pack(distinct[order]), pack(rank[where]))]})


def restore(payload: bytes) -> Block:
    ids, *rest = unbundle(payload)
    lens, keys, codes = (unpack(x, kind=np.int64) for x in rest)
    b = Block.__new__(Block)
    b.ids, b.lens = [i or None for i in zlib.decompress(ids).decode().split("\n")], lens
    b.flat = keys.view(np.uint64)[codes]
    b.train = np.array([not held_out(i) for i in b.ids])
    return b


def score_documents(parts: int, stats: list[list[int]]):
    """Score a block; stats: of each length of n-gram, tokens, types and six counts of counts."""
    order, total, types = len(stats), stats[0][0], stats[0][1]
    d = [discounts(n[2:]) for n in stats]
    left = sum(r * (1 - d[0][r]) * stats[0][1 + r] for r in range(1, TOP + 1)) + SPARE * max(types - sum(stats[0][2 : 2 + TOP]), 0)
    unknown = left / total if total else 1.0

    def run(docs: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        name, b = docs["block"].iloc[0], restore(docs["payload"].iloc[0])
        doc, n = b.documents(), len(b.ids)
        token = np.ones(len(doc), bool)
        token[np.cumsum(b.lens) - b.lens] = False

        # places[k], counted[k], part_of[k]: of n-grams of k + 1 words; a place is the entry in the block's table, -1 without n-gram
        places, counted, part_of = [], [], []
        for k, (at, keys) in enumerate(b.grams(order)):
            _, part, place, _, _ = b.table(at, keys, parts)
            own = Counted(back.loc[back["level"] == k + 1])
            if len(own.counts) != len(part):
                raise ValueError("a block lost its counts")
            full = np.full(len(doc), -1, np.int32)
            full[at] = place
            places.append(full), counted.append(own), part_of.append(part)

        def share(k: int, at: np.ndarray) -> np.ndarray:
            """Discounted share of the n-grams that end at ``at``, which were seen if k > 0."""
            c = counted[k].counts[places[k][at]]
            if k == 0:
                return np.where(c > 0, discounted(c, d[0]) / max(total, 1), unknown)
            return discounted(c, d[k]) / np.maximum(counted[k - 1].counts[places[k - 1][at - 1]], 1)

        score, open_ = np.zeros(len(doc)), np.flatnonzero(token)
        waits: list[tuple[np.ndarray, np.ndarray]] = []  # tokens and the histories whose weights they wait for, from the longest
        for k in range(order - 1, 0, -1):
            inner = places[k][open_] >= 0
            at = open_[inner]
            history = places[k - 1][at - 1]
            c_history = counted[k - 1].counts[history]
            seen = counted[k].counts[places[k][at]] > 0
            score[at[seen]] += np.log10(share(k, at[seen]))
            back_off = ~seen & (c_history > 0)
            score[at[back_off]] -= np.log10(c_history[back_off])
            waits.append((at[back_off], history[back_off]))
            open_ = np.concatenate((open_[~inner], at[~seen]))
        score[open_] += np.log10(share(0, open_))
        known = np.where(token, counted[0].counts[places[0]], 0)
        base = np.where(token, np.log10((known + 1) / (total + types + 1)), 0.0)
        sums = lambda x: np.bincount(doc, x, n)
        tokens, n_known, base, score = sums(token), sums(known > 0), sums(base), sums(score)

        # What this block owns of each history, and which weights it waits for
        rows, slots, first = [], [], 0
        edges = np.arange(parts + 1)
        for k, (at, history) in enumerate(reversed(waits)):
            size = len(counted[k].counts)
            ends = np.flatnonzero(places[k + 1] >= 0)
            one = np.zeros(len(counted[k + 1].counts), np.int64)
            one[places[k + 1][ends]] = ends  # one place of each n-gram
            own = one[counted[k + 1].owner & (counted[k + 1].counts > 0)]
            own = own[counted[k].wanted[places[k][own - 1]]]
            h, c = places[k][own - 1], counted[k + 1].counts[places[k + 1][own]]
            mass = np.bincount(h, c - discounted(c, d[k + 1]), size)
            after = np.bincount(h, share(k, own), size)
            need = np.zeros(size, bool)
            need[history] = True
            slots.append((doc[at], first + (np.cumsum(need) - 1)[history]))
            first += int(need.sum())
            edge = np.searchsorted(part_of[k], edges)
            for p in range(parts):
                local = np.arange(edge[p], edge[p + 1])
                local = local[(mass[local] > 0) | need[local]]
                if len(local):
                    payload = bundle(pack(counted[k].number[local], True), pack(mass[local]), pack(after[local]), pack_bits(need[local]))
                    rows.append((name, k + 1, p, None, None, None, None, None, payload))
        pending: dict[int, bytes] = {}
        if first:
            of, slot = (np.concatenate(x) for x in zip(*slots))
            by = np.argsort(of, kind="stable")
            of, slot = of[by], slot[by]
            edge = np.searchsorted(of, np.arange(n + 1))
            pending = {i: pack(slot[edge[i] : edge[i + 1]]) for i in np.unique(of).tolist()}
        rows += [(name, 0, None, i, int(t), int(k), float(x), float(y), pending.get(j)) for j, (i, t, k, x, y) in enumerate(zip(b.ids, tokens, n_known, base, score))]
        if len(b.flat) > 100_000:
            del b, doc, token, places, counted, part_of, known, waits, slots
            give_back()
        frame = pd.DataFrame(rows, columns=["block", "level", "part", "doc_id", "n_tokens", "n_known", "base", "score", "payload"])
        return frame.astype({"part": "Int32", "n_tokens": "Int64", "n_known": "Int64"})

    return run


def weigh(rows: pd.DataFrame) -> pd.DataFrame:
    """Backoff weights (times the history's count) of one part's histories; each block gets those it needs."""
    sent = []
    for p in rows["payload"]:
        x = unbundle(p)
        number = unpack(x[0], True, np.int64)
        sent.append((number, unpack(x[1], kind=np.float64), unpack(x[2], kind=np.float64), unpack_bits(x[3], len(number))))
    numbers, where = np.unique(np.concatenate([s[0] for s in sent]), return_inverse=True)
    mass = np.bincount(where, np.concatenate([s[1] for s in sent]), len(numbers))
    after = np.bincount(where, np.concatenate([s[2] for s in sent]), len(numbers))
    weight = mass / np.maximum(1 - after, 1e-12)
    out, at = [], 0
    for block, level, part, s in zip(rows["block"], rows["level"], rows["part"], sent):
        own = weight[where[at : at + len(s[0])]][s[3]]
        at += len(s[0])
        if len(own):
            out.append((block, level, part, pack(own)))
    return pd.DataFrame(out, columns=["block", "level", "part", "payload"])


def settle(docs: pd.DataFrame, weights: pd.DataFrame) -> pd.DataFrame:
    """Add the logarithms of the weights that a block's documents waited for."""
    if docs.empty:
        return docs[["doc_id", "n_tokens", "n_known", "base", "score"]]
    logs = np.log10(np.concatenate([unpack(p, kind=np.float64) for p in weights.sort_values(["level", "part"])["payload"]]))
    more = [float(logs[unpack(p, kind=np.int64)].sum()) for p in docs["payload"]]
    out = docs[["doc_id", "n_tokens", "n_known", "base", "score"]].copy()
    out["score"] = out["score"] + more
    return out


def score(documents: DataFrame, order: int = 3) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each document; n-grams of up to ``order`` words."""
    if order < 1:
        raise ValueError("order must be 1 at least")
    parts = parts_for(documents)
    texts = gathered(documents).select(id_text(), "text")
    spark = documents.sparkSession
    tables, stats = [], []
    for n in range(1, order + 1):
        tables.append(cut(texts.mapInPandas(send(parts, n), _SENT).groupBy("part").applyInPandas(count_part(n, order), _COUNTED)))
        stats.append([int(x or 0) for x in tables[-1].agg(*(F.sum(c) for c in ("tokens", "types", *(f"n{r}" for r in range(1, 7))))).first()])
        drop_shuffles(spark)
    back = tables[0].select("block", F.lit(1).alias("level"), "part", "payload")
    for n, t in enumerate(tables[1:], 2):
        back = back.unionByName(t.select("block", F.lit(n).alias("level"), "part", "payload"))
    own = texts.mapInPandas(documents_of, _SENT)
    scored = cut(own.groupBy("block").cogroup(back.groupBy("block")).applyInPandas(score_documents(parts, stats), _SCORED))
    drop_shuffles(spark)
    weights = scored.where("level > 0").select("block", "level", "part", "payload").groupBy("level", "part").applyInPandas(weigh, _WEIGHED)
    result = "doc_id string, n_tokens long, n_known long, base double, score double"
    waiting = scored.where("level = 0 and payload is not null").groupBy("block").cogroup(weights.groupBy("block")).applyInPandas(settle, result)
    done = scored.where("level = 0 and payload is null").select("doc_id", "n_tokens", "n_known", "base", "score").unionByName(waiting)
    done = done.withColumn("doc_id", F.col("doc_id").cast("long"))
    out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2, F.lit(False))
    return done.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", F.lit(stats[0][0]).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")
