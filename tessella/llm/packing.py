"""Sequence packing: shortest-pack-first over the histogram of piece lengths.

Documents are tokenised with the public byte-level BPE vocabulary, closed by the id 0 and
cut into full sequences and one remainder.  Only the histogram of lengths (at most
``size`` rows) reaches the driver, which places lengths longest first, each into the pack
with the most room, and updates the counts of packing patterns.  Patterns are joined back
to pieces by rank within their length.

Edge cases: null text is empty (one id, the closing 0); repeated rows and equal texts are
pieces of their own; a null doc_id is a document with that id; an empty table gives no
piece; other columns, whatever their names, are ignored; a text of any length is cut whole, never
shortened; pieces of equal length are ranked by a hash block, then id, start and checksum, so ties
are between equal pieces only, which may change places.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import materialize, thrifty

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PIECE_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
SPECIAL = "<|endoftext|>"


class Encoder:
    """Token ids as packed little-endian 32-bit integers.

    A single space between two non-blank characters always starts a new word of the
    tokenizer's pattern, so texts are cut there and each part is encoded once per cache
    life.  Parts go through tiktoken, which has the same ranks and gives the same ids as
    ``tokenizers``; a text with the special token's string goes through ``tokenizers``."""

    def __init__(self, name: str, most: int = 300_000):
        import base64
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.parts = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.cache: dict[str, bytes] = {}
        self.most = most

    def encode(self, text: str) -> bytes:
        if SPECIAL in text:
            return np.asarray(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        head, *words = text.split(" ")
        cache, encode = self.cache, self.parts.encode_ordinary
        apart = not head[-1:].isspace()
        missing = [w for w in set(words) if w not in cache] if apart else []
        if len(cache) + len(missing) > self.most:
            cache.clear()
            missing = list(set(words))
        for w in missing:
            if not w or len(w) > 256 or w[0].isspace() or w[-1].isspace():
                apart = False
                break
            cache[w] = np.asarray(encode(f" {w}"), "<u4").tobytes()
        if not apart:
            return np.asarray(encode(text), "<u4").tobytes()
        return np.asarray(encode(head), "<u4").tobytes() + b"".join([cache[w] for w in words])


def cut(doc_id, ids: bytes, size: int):
    """Rows of PIECES: full sequences, then what is left."""
    n = len(ids) // 4
    for start in range(0, n, size):
        piece = ids[4 * start : 4 * (start + size)]
        yield doc_id, start, len(piece) // 4, zlib.crc32(piece), n


def tokenize(docs: DataFrame, size: int = 1024, tokenizer: str = "byte_bpe_50k") -> DataFrame:
    """One row of PIECES per piece of every document of (doc_id, text)."""
    def run(batches):
        encoder = Encoder(tokenizer)
        end = b"\0\0\0\0"
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows += cut(doc_id, encoder.encode(text.as_py() or "") + end, size)
                if len(rows) > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], PIECE_NAMES)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], PIECE_NAMES)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(thrifty(run), PIECES)


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a pattern, how many sequences follow it), longest lengths first.

    Of the open packs the shortest (most room) takes the next length; all pieces of one
    length are placed together, so the work depends on the histogram alone."""
    by_room: dict[int, dict[tuple[int, ...], int]] = {}
    rooms: list[int] = []
    done: dict[tuple[int, ...], int] = {}

    def put(pattern, count, room):
        if room == 0:
            done[pattern] = done.get(pattern, 0) + count
            return
        if room not in by_room:
            by_room[room] = {}
            rooms.insert(bisect_right(rooms, room), room)
        by_room[room][pattern] = by_room[room].get(pattern, 0) + count

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = rooms[-1] if rooms else 0
            if room < length:
                put((length,), left, size - length)
                break
            packs = by_room[room]
            pattern, count = packs.popitem()
            if not packs:
                del by_room[room]
                rooms.remove(room)
            used = min(count, left)
            if count > used:
                put(pattern, count - used, room)
            put((*pattern, length), used, room - length)
            left -= used
    for packs in by_room.values():
        for pattern, count in packs.items():
            done[pattern] = done.get(pattern, 0) + count
    return sorted(done.items(), reverse=True)


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first rank of each slot run, its first sequence and its offset."""
    found: dict[int, list[tuple[int, int, int]]] = {}
    ranks: dict[int, int] = {}
    first = 0
    for pattern, count in patterns:
        offset = 0
        for length in pattern:
            rank = ranks.get(length, 0)
            found.setdefault(length, []).append((rank, first, offset))
            ranks[length] = rank + count
            offset += length
        first += count
    return {k: tuple(np.array(x, np.int64) for x in zip(*v)) for k, v in found.items()}


def ranked(pieces: DataFrame, blocks: int) -> DataFrame:
    """``pieces`` with rank, 0-based within equal length.  Lengths are split into
    ``blocks`` salted blocks ranked apart; block counts give each block its first rank."""
    salt = F.pmod(F.xxhash64("doc_id", "start"), F.lit(blocks)).cast("int")
    salted = pieces.withColumn("_block", salt)
    counts = salted.groupBy("length", "_block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("length", "_block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first"))
    own = Window.partitionBy("length", "_block").orderBy("doc_id", "start", "ids_crc32")
    numbered = salted.withColumn("_own", F.row_number().over(own) - 1)
    return numbered.join(firsts, ["length", "_block"]).withColumn("rank", F.col("_own") + F.col("_first")).drop("_block", "_own", "_first")


def pack(docs: DataFrame, size: int = 1024, tokenizer: str = "byte_bpe_50k") -> DataFrame:
    """PIECES with sequence_id and offset: where each piece lies."""
    pieces = materialize(tokenize(docs, size, tokenizer), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = slots(shortest_pack_first(histogram, size))
    blocks = max(1, min(4096, sum(histogram.values()) // 50_000 + 1)) * 8

    def place(batches):
        for batch in batches:
            lengths, rank = batch.column(2).to_numpy(), batch.column(5).to_numpy()
            sequence = np.zeros(len(lengths), np.int64)
            offset = np.zeros(len(lengths), np.int64)
            for length in np.unique(lengths):
                at = np.flatnonzero(lengths == length)
                ranks, first, where = places[int(length)]
                run = np.searchsorted(ranks, rank[at], side="right") - 1
                sequence[at] = first[run] + rank[at] - ranks[run]
                offset[at] = where[run]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*PIECE_NAMES, "sequence_id", "offset"])

    return ranked(pieces, blocks).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank").mapInArrow(place, PIECES + ", sequence_id long, offset long")
