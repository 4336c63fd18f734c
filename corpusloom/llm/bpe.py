"""Byte-level BPE encoding by a global shuffle of distinct words, and decoding through the token-byte table.

1. Documents are cut into pre-tokens where they lie.  A block (a run of documents of one input partition with
   at most BLOCK_WORDS distinct pre-tokens) keeps each document as the sequence of its pre-tokens' codes in the
   block, so the position of each pre-token is its place in the sequence.
2. The distinct pre-tokens of all blocks meet by hash; each is encoded once, and its ids go back to the blocks
   that hold it.
3. The distinct ids of each block are joined with the token-byte table.
4. A block's codes are replaced by ids, in order of position, and each id by the bytes that the join gave.

A hot pre-token is one entry per block, however often it occurs.  Blocks are named by their content and place
(partition, number in the partition), so that blocks of the same rows stay apart; if a lost executor makes Spark
cut blocks again, they get their names again; where the input's rows then
came in another order, a block would miss its words and the job would stop rather than give wrong ids.

Defined results: null text is empty and has no tokens; repeated rows and null doc_id give rows of their own; an
empty table gives no rows; columns other than doc_id and text are ignored.  ``documents`` is read once.
"""

from __future__ import annotations

import base64
import hashlib
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, gathered, give_back, id_text, partition, parts_for

#: A block ends once it holds this many distinct pre-tokens (or codes, below), which bounds a task's memory.
BLOCK_WORDS, BLOCK_CODES = 250_000, 8_000_000
#: Codes in one row of a block.
ROW_CODES = 500_000
_BLOCK = "block long, kind int, part int, ids array<string>, counts array<int>, payload binary"
_ENCODED = "block long, kind int, part int, ids array<int>, counts array<int>, payload binary"


def read_ranks(path: str) -> bytes:
    """The rank file, read on the driver and sent to executors (about 1 MB)."""
    with open(path, "rb") as f:
        return f.read()


def rank_table(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}


def _class(kind: str) -> str:
    """The code points whose general category begins with ``kind``, as ranges for a character class."""
    out, start, prev = [], None, None
    for c in range(0x110000):
        if 0xD800 <= c < 0xE000 or not unicodedata.category(chr(c)).startswith(kind):
            continue
        if prev is not None and c == prev + 1:
            prev = c
            continue
        if start is not None:
            out.append((start, prev))
        start = prev = c
    out.append((start, prev))
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


def splitter(pattern: str):
    """A function from text to its matches of ``pattern``.

    The standard library's engine needs explicit classes; white space is Unicode's White_Space.
    """
    space = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
    letters, numbers = _class("L"), _class("N")
    p = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{letters}{numbers}]").replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]")
    p = p.replace(r"(?!\S)", f"(?![^{space}])").replace(r"\s", f"[{space}]")
    return re.compile(p).findall


class Codes(dict):
    """Of each piece between single spaces, the codes of its pre-tokens; the piece is matched once, with its space.

    The pattern never matches across a single space between two visible characters but with the space as its first
    character.  A piece that is empty or has white space at an end has None: a text that holds it is cut slowly.
    """

    def __init__(self, findall, words: dict, lead: str):
        self.findall, self.words, self.lead = findall, words, lead

    def __missing__(self, piece: str):
        clean = piece != "" and not piece[0].isspace() and not piece[-1].isspace()
        self[piece] = got = self.of(self.lead + piece) if clean else None
        return got

    def of(self, text: str) -> list[int]:
        return [self.words.setdefault(w, len(self.words)) for w in self.findall(text)]


_CUT = re.compile(r"(?<=\S) (?=\S)")


def codes_of(text: str, first: Codes, later: Codes) -> list[int]:
    head, *rest = text.split(" ")
    try:
        return first[head] + [c for piece in rest for c in later[piece]]
    except TypeError:  # a piece of the text is None
        head, *rest = _CUT.split(text)
        out = first.of(head)
        for piece in rest:
            out += later.get(piece) or first.of(" " + piece)
        return out


def pack(codes: np.ndarray) -> bytes:
    """Varint bytes of non-negative integers below 2**28, compressed."""
    v = codes.astype(np.uint32)
    n = 1 + (v >= 1 << 7).astype(np.int64) + (v >= 1 << 14) + (v >= 1 << 21)
    end = np.cumsum(n)
    out = np.zeros(int(end[-1]) if len(v) else 0, np.uint8)
    at = end - n
    for k in range(4):
        more = n > k
        out[at[more] + k] = ((v[more] >> (7 * k)) & 127) | ((n[more] > k + 1) << 7)
    return zlib.compress(out.tobytes(), 1)


def unpack(raw: bytes) -> np.ndarray:
    b = np.frombuffer(zlib.decompress(raw), np.uint8)
    last = np.flatnonzero(b < 128)
    start = np.concatenate(([0], last[:-1] + 1)) if len(last) else last
    n, v = last - start + 1, np.zeros(len(last), np.uint32)
    for k in range(4):
        more = n > k
        v[more] |= (b[start[more] + k] & 127).astype(np.uint32) << (7 * k)
    return v


def make_blocks(pattern: str, parts: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        findall = splitter(pattern)

        def finish(ids, docs, words, place):
            lens = np.array([len(d) for d in docs], np.int64)
            flat = np.concatenate([np.asarray(d, np.int32) for d in docs]) if docs else np.zeros(0, np.int32)
            order = np.argsort(-np.bincount(flat, minlength=len(words)), kind="stable")
            rank = np.empty(len(words), np.int64)
            rank[order] = np.arange(len(words))
            flat = rank[flat]
            names = sorted(words, key=words.get)
            part = np.array([zlib.crc32(w.encode()) % parts for w in names], np.int64) if names else np.zeros(0, np.int64)
            digest = hashlib.blake2b(digest_size=8)
            digest.update(repr((place, ids)).encode() + lens.tobytes() + flat.tobytes())
            for w in names:
                digest.update(w.encode() + b"\0")
            block = int.from_bytes(digest.digest(), "little", signed=True)
            rows = []
            by_part = np.argsort(part, kind="stable")
            # kind 0: where each word of the parts, laid end to end, stands among the codes
            rows.append((block, 0, -1, None, None, zlib.compress(rank[by_part].astype(np.int32).tobytes(), 1)))
            edges = np.searchsorted(part[by_part], np.arange(parts + 1))
            for p in range(parts):
                own = [names[i] for i in by_part[edges[p] : edges[p + 1]]]
                if own:
                    raw = [w.encode() for w in own]
                    sizes = np.array([len(x) for x in raw])
                    rows.append((block, 1, p, None, None, zlib.compress(len(raw).to_bytes(4, "little") + sizes.astype(np.uint32).tobytes() + b"".join(raw), 1)))
            at = first = 0
            starts = np.concatenate(([0], np.cumsum(lens)))
            while first < len(ids):
                last = max(first + 1, int(np.searchsorted(starts, starts[first] + ROW_CODES, "right")) - 1)
                rows.append((block, 2, at, ids[first:last], lens[first:last].tolist(), pack(flat[starts[first] : starts[last]])))
                first, at = last, at + 1
            for i in range(0, len(rows), 64):
                yield pd.DataFrame(rows[i : i + 64], columns=["block", "kind", "part", "ids", "counts", "payload"])

        own_partition, number = partition(), 0

        def opened():
            words: dict[str, int] = {}
            return [], [], words, Codes(findall, words, ""), Codes(findall, words, " "), 0

        ids, docs, words, first, later, n = opened()
        for batch in batches:
            for i, text in zip(batch["doc_id"], batch["text"]):
                codes = codes_of(text, first, later) if isinstance(text, str) and text else []
                ids.append(i)
                docs.append(np.array(codes, np.int32))
                n += len(codes)
                if len(words) >= BLOCK_WORDS or n >= BLOCK_CODES:
                    yield from finish(ids, docs, words, (own_partition, number))
                    ids, docs, words, first, later, n = opened()
                    number += 1
        if ids:
            yield from finish(ids, docs, words, (own_partition, number))
        ids, docs, words, first, later, n = opened()
        give_back()

    return run


def encode_words(raw_ranks):
    """All pre-tokens of one part: each distinct one is encoded once."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        import tiktoken

        # A pattern that takes any text whole, so that a pre-token is merged as the one piece it is
        encode = tiktoken.Encoding("ranks", pat_str=r"[\s\S]+", mergeable_ranks=rank_table(raw_ranks.value), special_tokens={}).encode_ordinary
        known: dict[bytes, list[int]] = {}
        out = []
        for block, part, payload in zip(rows["block"], rows["part"], rows["payload"]):
            raw = zlib.decompress(payload)
            n = int.from_bytes(raw[:4], "little")
            ends = 4 + 4 * n + np.concatenate(([0], np.cumsum(np.frombuffer(raw, np.uint32, n, 4)))).astype(np.int64)
            counts, ids = np.empty(n, np.uint32), []
            for k, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
                word = raw[a:b]
                got = known.get(word)
                if got is None:
                    got = known[word] = encode(word.decode())
                counts[k] = len(got)
                ids += got
            packed = pack(counts)
            out.append((block, 1, part, np.unique(np.array(ids, np.int32)), [n], len(packed).to_bytes(4, "little") + packed + pack(np.array(ids, np.uint32))))
        return pd.DataFrame(out, columns=["block", "kind", "part", "ids", "counts", "payload"])

    return run


def assemble(digests: bool):
    """One block: its codes become ids in order of position, and ids become the bytes that the join returned."""

    def run(rows: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        token_bytes: dict[int, bytes] = {}
        if digests:
            returned = words[words["kind"] == 3]
            token_bytes = {t: b for ids, own in zip(returned["ids"], returned["bytes"]) for t, b in zip(ids.tolist(), own)}
        words = words[words["kind"] == 1]
        order = np.frombuffer(zlib.decompress(rows.loc[rows["kind"] == 0, "payload"].iloc[0]), np.int32)
        counts, ids = [], []
        for payload in words.sort_values("part")["payload"]:
            raw = bytes(payload)
            n = int.from_bytes(raw[:4], "little")
            counts.append(unpack(raw[4 : 4 + n]))
            ids.append(unpack(raw[4 + n :]))
        count = np.concatenate(counts) if counts else np.zeros(0, np.uint32)
        flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        if len(count) != len(order):
            raise ValueError("a block lost words of its dictionary")
        ends = np.cumsum(count.astype(np.int64))
        flat_list = flat.tolist()
        of_code: list = [None] * len(order)
        for code, a, b in zip(order.tolist(), (ends - count).tolist(), ends.tolist()):
            of_code[code] = flat_list[a:b]
        lens = np.array([len(x) for x in of_code], np.int64)
        if digests:
            as_text = [",".join(map(str, x)) for x in of_code]
            as_bytes = [b"".join([token_bytes[t] for t in x]) for x in of_code]
        out = []
        for doc_ids, sizes, payload in rows.loc[rows["kind"] == 2, ["ids", "counts", "payload"]].itertuples(index=False):
            codes, at = unpack(payload), 0
            listed = codes.tolist()
            for doc, size in zip(doc_ids, sizes):
                size = int(size)
                own = listed[at : at + size]
                n = int(lens[codes[at : at + size]].sum()) if size else 0
                if digests:
                    out.append((doc, n, hashlib.sha256(",".join([as_text[c] for c in own]).encode()).hexdigest(), hashlib.sha256(b"".join([as_bytes[c] for c in own])).hexdigest()))
                else:
                    out.append((doc, n, [t for c in own for t in of_code[c]]))
                at += size
        if len(order) > 50_000:
            of_code, as_text, as_bytes = [], [], []
            give_back()
        return pd.DataFrame(out, columns=["doc_id", "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("token_ids",))])

    return run


def encode(documents: DataFrame, ranks_path: str, pattern: str, digests: bool = False) -> DataFrame:
    """doc_id, n_tokens and token_ids for each document; with ``digests`` the digests of ids and decoded bytes instead."""
    spark = documents.sparkSession
    ranks = spark.sparkContext.broadcast(read_ranks(ranks_path))
    parts = parts_for(documents)
    # One exchange by block serves both branches.  A filter that names the partition is not pushed below it, so
    # that the branches share it and texts are cut into pre-tokens once.
    blocks = gathered(documents).select(id_text(), "text").mapInPandas(make_blocks(pattern, parts), _BLOCK).repartition("block")
    only = lambda what: F.when(F.spark_partition_id() >= 0, what)
    encoded = blocks.where(only(F.col("kind") == 1)).groupBy("part").applyInPandas(encode_words(ranks), _ENCODED)
    if digests:  # likewise shared: the ids of a block meet their bytes where the block is
        # The filter names all columns, or each use would prune its own ones and so get an exchange of its own.
        whole = F.when(F.spark_partition_id() >= 0, F.lit(True)).otherwise(F.hash(*encoded.columns) > 0)
        encoded = encoded.repartition("block").where(whole)
        used = encoded.groupBy("block").agg(F.array_distinct(F.flatten(F.collect_list("ids"))).alias("ids"))
        used = used.select("block", F.explode("ids").alias("token_id"))
        pairs = used.join(F.broadcast(token_table(documents, ranks_path)), "token_id").groupBy("block").agg(F.collect_list(F.struct("token_id", "bytes")).alias("t"))
        tokens = pairs.select("block", F.lit(3).alias("kind"), F.lit(-1).alias("part"), F.col("t.token_id").alias("ids"), F.col("t.bytes").alias("bytes"), F.lit(None).cast("binary").alias("payload"))
        back = encoded.select("block", "kind", "part", F.lit(None).cast("array<int>").alias("ids"), F.lit(None).cast("array<binary>").alias("bytes"), "payload").unionByName(tokens)
    else:
        back = encoded.select("block", "kind", "part", "payload")
    out = "doc_id string, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "token_ids array<int>")
    done = blocks.where(only(F.col("kind") != 1)).groupBy("block").cogroup(back.groupBy("block")).applyInPandas(assemble(digests), out)
    return done.withColumn("doc_id", F.col("doc_id").cast("long"))


def token_table(documents: DataFrame, ranks_path: str) -> DataFrame:
    """token_id, bytes: one row per rank, as many as the rank file has."""
    rows = sorted((v, bytearray(k)) for k, v in rank_table(read_ranks(ranks_path)).items())
    return documents.sparkSession.createDataFrame(rows, "token_id int, bytes binary")


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, text: token ids joined with the token-byte table (bounded by the rank file) and put together by position.

    Positions of one document meet in one row, as its text does.  Bytes that are not UTF-8 become U+FFFD.
    """
    numbered = cut(encoded.select(F.monotonically_increasing_id().alias("row"), "doc_id", "token_ids"))
    rows = numbered.select("row", "doc_id", F.posexplode_outer("token_ids").alias("pos", "token_id"))
    rows = rows.join(F.broadcast(token_table(encoded, ranks_path)), "token_id", "left")
    parts = F.array_sort(F.collect_list(F.struct("pos", F.hex("bytes").alias("h"))))
    return rows.groupBy("row", "doc_id").agg(parts.alias("parts")).select("doc_id", F.decode(F.unhex(F.array_join(F.transform("parts", lambda p: p["h"]), "")), "UTF-8").alias("text"))
