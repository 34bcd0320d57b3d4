"""Substring deduplication by factors along matched windows, in the manner of relative Lempel-Ziv.

The corpus is its own reference, in blocks: each map task's documents.  A document may
copy from any document with a smaller id.  Of a relative Lempel-Ziv parse it has the index of
reference blocks, the greedy pass and the check at factor boundaries; it does not seek the longest
match, as a window's source is its smallest document, not the one that goes on longest.  The words
removed are the same: those of all windows that have a source.

1. Index.  Each window of ``window`` words has an anchor, the least hash of its runs of
   RUN words, so equal windows share an anchor in whatever documents they stand.  Anchors
   of all blocks meet by hash; those of a single document cannot start a copy and go.
2. Match.  Documents with shared anchors fingerprint the windows around them (96 bits).
   Equal fingerprints meet by hash, and each window learns the smallest document that
   holds it and the place there.
3. Parse.  A document is factored greedily: a factor starts at a window with a source and
   runs on along that source's diagonal; where the next window has another source, or
   none, the factor ends.  As every window at a factor's boundary is looked up itself, no
   window that straddles two factors is missed.  Factors of at least ``window`` words are
   duplicate spans and their words go.

In steps 1 and 2 every task first combines its own block: of the documents of a block
that share a key, one entry stands for all, so text that a third of all documents share
costs a row a block and no task gathers those documents.

A row is known by ``row``, a 64-bit hash of doc_id and text: rows of one doc_id with different
texts are matched, parsed and returned each for itself, and doc_id only orders them.

Edge cases: null text has no words; a null doc_id is neither a source nor changed; rows
with equal doc_id do not remove each other's words, and equal rows lose the same words; of a
window that stands several times in its smallest document the first place is the source (a tie
changes factors, never the words removed); documents shorter than a window stay; a text of any
length is taken whole; an empty table gives no row; other columns are kept.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import blobs
from tessella.llm.common import materialize, release, rows_of_text, thrifty
from tessella.llm.words import mix, spans, word_hashes

RUN = 7  # words of an anchor
ANCHOR = np.dtype([("key", "<u4"), ("row", "<i8"), ("many", "?")])
WINDOW = np.dtype([("h", "<u8"), ("g", "<u4"), ("doc", "<i8"), ("row", "<i8"), ("at", "<i4")])
SOURCE = np.dtype([("at", "<i4"), ("doc", "<i8"), ("there", "<i4"), ("windows", "<i4")])  # a run along a diagonal
KEY = np.dtype([("to", "<i8"), ("key", "<u4")])  # a shared anchor of row `to`
FOUND = np.dtype([("to", "<i8"), *((name, SOURCE[name]) for name in SOURCE.names)])
BLOCK = 1_000_000  # entries that a map task holds before it combines and sends them


def window_anchors(hashes: np.ndarray, pointer: np.ndarray, window: int):
    """(first words, rows, anchors) of all windows of the rows' word hashes."""
    at, rows, _ = spans(hashes, pointer, window)
    if not len(at):
        return at, rows, np.zeros(0, np.uint64)
    n = len(hashes) - RUN + 1
    runs = np.zeros(n, np.uint64)
    for k in range(RUN):
        runs += hashes[k : k + n] * np.uint64(2 * (k * 0x51ED270B + 0x2545F491) + 1)
    least, width, want = mix(runs), 1, window - RUN + 1
    while width < want:  # the least of `want` neighbours, by doubling
        step = min(width, want - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    return at, rows, least[at]


def key32(anchors: np.ndarray) -> np.ndarray:
    return (anchors >> np.uint64(32)).astype(np.uint32)


def _firsts(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal rows of sorted columns begins."""
    change = np.zeros(len(columns[0]), bool)
    change[:1] = True
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    return change


def _send(out: blobs.Out, records: np.ndarray, n: int) -> None:
    """Records for rows, by the bucket of the row, for the next exchange."""
    blobs.by_key(out, 0, (mix(records["to"].astype(np.uint64)) % np.uint64(n)).astype(np.int64), records, n)


def _send_keys(out: blobs.Out, rows: np.ndarray, keys: np.ndarray, n: int) -> None:
    records = np.zeros(len(rows), KEY)
    records["to"], records["key"] = rows, keys
    _send(out, records, n)


def _by_row(rows: DataFrame, kind: np.dtype, name: str, n: int) -> DataFrame:
    """(row, name): all records of a row in one value, without their ``to``."""
    payload = np.dtype([(field, kind[field]) for field in kind.names if field != "to"])

    def gather(parts, out, bucket):
        records = np.frombuffer(b"".join(parts), kind)
        bare = np.zeros(len(records), payload)
        for field in payload.names:
            bare[field] = records[field]
        blobs.by_key(out, bucket, records["to"], bare)

    again = rows.select(F.col("key").cast("int").alias("bucket"), F.lit(None).cast("long").alias("key"), "data")
    return blobs.reduce_buckets(again, gather, n).select(F.col("key").alias("row"), F.array("data").alias(name))


def _send_anchors(out: blobs.Out, anchors: np.ndarray, ids: np.ndarray, n: int) -> None:
    order = np.lexsort((ids, anchors))
    anchors, ids = anchors[order], ids[order]
    one = _firsts(anchors, ids)
    anchors, ids = anchors[one], ids[one]
    head = np.flatnonzero(_firsts(anchors))
    size = np.diff(np.append(head, len(anchors)))
    many = np.repeat(size > 1, size)
    _send_keys(out, ids[many], key32(anchors[many]), n)
    entries = np.zeros(len(head), ANCHOR)
    entries["key"], entries["row"], entries["many"] = key32(anchors[head]), ids[head], size > 1
    blobs.split_by(out, (anchors[head] % np.uint64(n)).astype(np.int32), entries)


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, row, text) of the rows that have a doc_id."""
    doc_id = F.col("doc_id").cast("long")
    return docs.filter("doc_id is not null").select(doc_id.alias("doc_id"), F.xxhash64(doc_id, "text").alias("row"), "text")


def shared_anchors(rows: DataFrame, window: int) -> DataFrame:
    """(row, keys): 32-bit keys of the anchors that other rows of ``keyed`` rows have too."""
    n = blobs.n_buckets(rows)

    def index(batches):
        out, held, size = blobs.Out(), [], 0
        for ids, data, offsets in rows_of_text(batches, "row"):
            at, of, anchors = window_anchors(*word_hashes(data, offsets), window)
            if len(at):
                one = _firsts(of, anchors)  # neighbours often share their anchor
                held.append((anchors[one], ids[of[one]]))
                size += int(one.sum())
            if size > BLOCK:
                _send_anchors(out, *map(np.concatenate, zip(*held)), n)
                held, size = [], 0
            yield from out.take()
        if held:
            _send_anchors(out, *map(np.concatenate, zip(*held)), n)
        yield from out.take(last=True)

    def meet(parts, out, bucket):
        entries = np.frombuffer(b"".join(parts), ANCHOR)
        entries = entries[np.argsort(entries["key"], kind="stable")]
        head = np.flatnonzero(_firsts(entries["key"]))
        size = np.diff(np.append(head, len(entries)))
        found = entries[np.repeat(size > 1, size) & ~entries["many"]]
        _send_keys(out, found["row"], found["key"], n)

    return _by_row(blobs.reduce_buckets(rows.select("row", "text").mapInArrow(thrifty(index), blobs.SCHEMA), meet, n), KEY, "keys", n)


def _send_windows(out: blobs.Out, entries: np.ndarray, anchors: np.ndarray, n: int) -> None:
    """Windows go by anchor, so neighbours in a text mostly go together."""
    order = np.lexsort((entries["at"], entries["row"], entries["doc"], entries["g"], entries["h"]))
    entries, anchors = entries[order], anchors[order]
    one = _firsts(entries["h"], entries["g"], entries["row"])
    entries, anchors = entries[one], anchors[one]
    heads = _firsts(entries["h"], entries["g"])
    _send_sources(out, entries, heads, n)
    entries, anchors = entries[heads], anchors[heads]
    order = np.lexsort((entries["at"], entries["row"]))  # in order of text blobs compress well
    blobs.split_by(out, (anchors[order] % np.uint64(n)).astype(np.int32), entries[order])


def _send_sources(out: blobs.Out, entries: np.ndarray, heads: np.ndarray, n: int) -> None:
    """FOUND records for entries whose group begins in a smaller document."""
    head = np.flatnonzero(heads)
    first = np.repeat(head, np.diff(np.append(head, len(entries))))
    later = np.flatnonzero(entries["doc"] > entries["doc"][first])
    later = later[np.lexsort((entries["at"][later], entries["row"][later]))]
    mine, theirs = entries[later], entries[first[later]]
    goes_on = (np.diff(mine["row"]) == 0) & (np.diff(mine["at"]) == 1) & (np.diff(theirs["row"]) == 0) & (np.diff(theirs["at"]) == 1)
    begin = np.flatnonzero(np.concatenate([[True], ~goes_on])) if len(later) else later
    found = np.zeros(len(begin), FOUND)
    found["to"] = mine["row"][begin]
    found["at"], found["doc"], found["there"] = mine["at"][begin], theirs["doc"][begin], theirs["at"][begin]
    found["windows"] = np.diff(np.append(begin, len(later)))
    _send(out, found, n)


def _prints(hashes: np.ndarray, pointer: np.ndarray, window: int):
    """(h, g) of all windows: 96 bits of two independent hashes."""
    return spans(hashes, pointer, window)[2], spans(hashes, pointer, window, 17)[2].astype(np.uint32)


def window_sources(rows: DataFrame, window: int) -> DataFrame:
    """(row, sources): packed SOURCE records of windows that start in a smaller document.
    ``rows`` has doc_id, row, text and keys of shared anchors."""
    n = blobs.n_buckets(rows)

    def match(batches):
        out, held, size = blobs.Out(), [], 0
        for batch in batches:
            docs, shared = batch.column(0).to_numpy(), batch.column(3)
            row = 0
            for ids, data, offsets in rows_of_text([batch], "row"):
                hashes, pointer = word_hashes(data, offsets)
                at, of, anchors = window_anchors(hashes, pointer, window)
                if len(at):
                    h, g = _prints(hashes, pointer, window)
                    mine = key32(anchors)
                    cuts = np.searchsorted(of, np.arange(len(ids) + 1))
                    fits = np.zeros(len(at), bool)
                    for r in np.flatnonzero(np.diff(cuts)):
                        known = np.frombuffer(b"".join(shared[row + r].as_py()), np.uint32)
                        fits[cuts[r] : cuts[r + 1]] = np.isin(mine[cuts[r] : cuts[r + 1]], known)
                    entries = np.zeros(int(fits.sum()), WINDOW)
                    entries["h"], entries["g"], entries["row"] = h[fits], g[fits], ids[of[fits]]
                    entries["doc"] = docs[row + of[fits]]
                    entries["at"] = at[fits] - pointer[of[fits]]
                    held.append((entries, anchors[fits]))
                    size += len(entries)
                row += len(ids)
                if size > BLOCK:
                    _send_windows(out, *map(np.concatenate, zip(*held)), n)
                    held, size = [], 0
                yield from out.take()
        if held:
            _send_windows(out, *map(np.concatenate, zip(*held)), n)
        yield from out.take(last=True)

    def meet(parts, out, bucket):
        entries = np.frombuffer(b"".join(parts), WINDOW)
        entries = entries[np.lexsort((entries["at"], entries["row"], entries["doc"], entries["g"], entries["h"]))]
        _send_sources(out, entries, _firsts(entries["h"], entries["g"]), n)

    found = blobs.reduce_buckets(rows.select("doc_id", "row", "text", "keys").mapInArrow(thrifty(match), blobs.SCHEMA), meet, n)
    return _by_row(found, FOUND, "sources", n)


def factors(at: np.ndarray, doc: np.ndarray, there: np.ndarray, window: int) -> np.ndarray:
    """Greedy factors (first word, words, source document, first word there) from windows in
    order of place, with their source documents and places there."""
    if not len(at):
        return np.zeros((0, 4), np.int64)
    goes_on = (np.diff(at) == 1) & (np.diff(there) == 1) & (np.diff(doc) == 0)
    first = np.flatnonzero(np.concatenate([[True], ~goes_on]))
    last = np.append(first[1:], len(at)) - 1
    return np.stack([at[first], at[last] - at[first] + window, doc[first], there[first]], axis=1)


def parse(data: np.ndarray, parts: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """(factors, whether each word goes) of a text; ``parts`` hold its SOURCE records, which
    cover every distinct window that has a source, where it first stands."""
    hashes, pointer = word_hashes(data, np.array([0, len(data)]))
    known = np.frombuffer(b"".join(parts), SOURCE)
    count = known["windows"].astype(np.int64)
    step = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    at, there = np.repeat(known["at"], count) + step, np.repeat(known["there"], count) + step
    doc = np.repeat(known["doc"], count)
    h, g = _prints(hashes, pointer, window)
    prints = np.empty(len(h), [("h", "<u8"), ("g", "<u4")])
    prints["h"], prints["g"] = h, g
    _, inverse = np.unique(prints, return_inverse=True)
    source_of = np.full(int(inverse.max()) + 1 if len(inverse) else 0, -1)
    source_of[inverse[at]] = np.arange(len(at))
    chosen = source_of[inverse]
    here = np.flatnonzero(chosen >= 0)
    chosen = chosen[here]
    found = factors(here, doc[chosen], there[chosen], window)
    edge = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edge, found[:, 0], 1)
    np.add.at(edge, found[:, 0] + found[:, 1], -1)
    return found, np.cumsum(edge)[:-1] > 0


KEPT = "doc_id long, row long, n_words long, n_removed long, kept_text string, kept_sha256 string, factors array<array<long>>"


def changed(docs: DataFrame, window: int = 13) -> DataFrame:
    """KEPT of the rows that hold a window of a smaller document, equal rows once: the words left,
    joined by one space, their SHA-256, and the factors."""
    rows = keyed(docs)
    likely = materialize(rows.join(shared_anchors(rows, window).hint("shuffle_hash"), "row").select("doc_id", "row", "text", "keys"), "shared-anchors")
    release(docs.sparkSession)
    sources = window_sources(likely, window)

    def run(batches):
        for batch in batches:
            out = []
            for doc_id, row, text, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                raw = (text.as_py() or "").encode()
                found, gone = parse(np.frombuffer(raw, np.uint8), parts.as_py(), window)
                kept = b" ".join(compress(raw.split(), ~gone))
                out.append((doc_id, row, len(gone), int(gone.sum()), kept.decode(), hashlib.sha256(kept).hexdigest(), found.tolist()))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], [f.split()[0] for f in KEPT.split(", ")])

    joined = likely.select("doc_id", "row", "text").join(sources.hint("shuffle_hash"), "row").select("doc_id", "row", "text", "sources")
    return joined.mapInArrow(thrifty(run), KEPT).dropDuplicates(["row"])


def untouched(docs: DataFrame) -> DataFrame:
    """(doc_id, row, n_words, whole_sha256): words of every row, joined by one space."""
    def run(batches):
        for batch in batches:
            words = [(x.as_py() or "").encode().split() for x in batch.column(2)]
            digests = [hashlib.sha256(b" ".join(w)).hexdigest() for w in words]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([len(w) for w in words], pa.int64()), pa.array(digests)], ["doc_id", "row", "n_words", "whole_sha256"])

    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), F.when(doc_id.isNotNull(), F.xxhash64(doc_id, "text")).alias("row"), "text")
    return rows.mapInArrow(run, "doc_id long, row long, n_words long, whole_sha256 string")


def dedup_substrings(docs: DataFrame, window: int = 13) -> DataFrame:
    """``docs`` with duplicate words cut out of ``text``, and n_removed; texts that lose nothing
    stay as they are.  An n_chars column follows the new text."""
    less = changed(docs, window).select(F.col("row").alias("id"), F.col("kept_text"), F.col("n_removed"))
    doc_id = F.col("doc_id").cast("long")
    own = F.when(doc_id.isNotNull(), F.xxhash64(doc_id, "text"))
    rows = docs.select(own.alias("own"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole"))  # names cannot clash
    found = rows.join(less.hint("shuffle_hash"), rows["own"] == less["id"], "left")
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("whole.text"))
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    kept = [new.get(c, F.col(f"whole.`{c}`")).alias(c) for c in docs.columns if c != "n_removed"]
    return found.select(*kept, F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"))
