"""N-gram Jaccard self-join by T-occurrence search, as connected components.

A document is the set of hashes of its ``width``-word shingles.  Documents with equal sets
are one node.  Two nodes link when intersection / union >= 4/5, so each side misses at
most d = n - ceil(4n/5) of its n shingles in the other.

1. Count.  Inverted lists of shingles are built over all nodes, in two families: nodes of up
   to SMALL shingles with all of them, nodes of at least LARGE with the share RATE of the
   hash range.  A linked pair meets in a family: one of the two that has more than d shingles
   in that range shares one there.  A thin node, one with d or fewer, takes part in a third
   family too, of thin nodes with all their shingles, where it meets other thin nodes.  Only
   list lengths are needed here, and only up to CAP.
2. Choose.  A node with more than d shingles that no other node has links with nothing.
   Of the others, the d + 1 in the shortest lists are the short lists of T-occurrence
   search: a linked pair shares one of them.  Each list gives a star of candidate edges, from its
   least node to the others.
3. Settle copies.  A node stands with the centre that it shares most short lists with; the leaves
   of a centre are cut into blocks of about STAR nodes, the centre in each, and every block is
   searched.  This is linear in nodes, and a group of copies of any size mostly becomes one
   component here.
4. Search the rest.  Candidate edges whose ends are in one component need no more work.  The
   others join components into open groups; a group's nodes are searched against each other.  A
   group that is too large for one block is cut into classes of size and these into cells, where
   large components have cells of their own; cells of one class or of neighbours make a block in
   pairs, but not two cells of one component.  So a component of many copies costs one block a cell
   for what stands beside it, and nothing for itself.
5. A block is searched with DivideSkip: a node's long lists are set aside, its short lists are
   merged and counted, and candidates that can still reach the overlap are probed in the long
   lists by binary search.  Pairs whose ends are connected already are skipped.

Every exchange combines entries of its task first: a shingle that a third of all nodes
share costs at most CAP entries a task in step 1 and one in step 2.  Node ids are 63-bit
hashes of whole sets; shingles are compared by 64-bit hashes.

Edge cases: null text and text without words are empty sets, which link with nothing; a
text of fewer than ``width`` words is one shingle; words are compared with A-Z lower-cased;
a text of any length is taken whole; repeated rows and equal texts share a node; a row with a
null doc_id takes part, bridges others and gets its group's least id, null when the group has
none; lists of equal length are ordered by their key, so ties give the same lists everywhere;
an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import blobs
from tessella.llm.common import materialize, release, rows_of_text, thrifty, utf8
from tessella.llm.components import components
from tessella.llm.words import mix, spans, word_hashes

SMALL, LARGE, RATE, CAP = 500, 400, 0.35, 64
STAR, PART_NODES, PART_SHINGLES = 128, 128, 500_000
BLOCK = 1_000_000
LIST = np.dtype([("key", "<u4"), ("node", "<u8"), ("full", "?")])
SHARE = np.dtype([("node", "<u8"), ("key", "<u8"), ("size", "<u4")])  # size 0: key is n and s
ENTRY = np.dtype([("key", "<u8"), ("node", "<u8")])
EDGE = np.dtype([("a", "<i8"), ("b", "<i8"), ("lists", "<i8")])
FAMILY = np.uint64(3)  # the lowest bits of a node id, free for the family


def needed(n):
    """Least overlap with a set of n shingles for similarity 4/5: ceil(4n / 5)."""
    return (4 * n + 4) // 5


def shingles(data: np.ndarray, offsets: np.ndarray, width: int):
    """(row, hash) of the distinct shingles of each row, sorted by row, then hash."""
    hashes, pointer = word_hashes(data, offsets, lower=True)
    _, rows, found = spans(hashes, pointer, width)
    count = np.diff(pointer)
    more = [(rows, found)]
    for few in range(1, width):
        short = np.flatnonzero(count == few)
        if len(short):
            h = np.zeros(len(short), np.uint64)
            for k in range(few):
                h = mix(h + hashes[pointer[short] + k] * np.uint64(2 * k + 3))
            more.append((short, mix(h + np.uint64(few))))
    rows, found = (np.concatenate(x) for x in zip(*more))
    order = np.lexsort((found, rows))
    rows, found = rows[order], found[order]
    one = np.ones(len(rows), bool)
    one[1:] = (rows[1:] != rows[:-1]) | (found[1:] != found[:-1])
    return rows[one], found[one]


def node_of(rows: np.ndarray, found: np.ndarray, n_rows: int):
    """(set size, node id) of each row; the lowest bits of an id are free."""
    n = np.bincount(rows, minlength=n_rows)
    total = np.zeros(n_rows, np.uint64)
    np.add.at(total, rows, mix(found))
    return n, mix(total + n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) & ~FAMILY & np.uint64(2**63 - 1)


def sampled(found: np.ndarray) -> np.ndarray:
    return found <= np.uint64(int(RATE * 2**64))


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, row, text): ``row`` is a hash of both, so rows without an id have one too."""
    return docs.select("doc_id", F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text").alias("row"), "text")


def nodes(docs: DataFrame, width: int = 5) -> DataFrame:
    """(doc_id, row, n, node): set size and node id of each row of ``keyed`` rows."""
    def run(batches):
        for batch in batches:
            done = 0
            for keys, data, offsets in rows_of_text([batch], "row"):
                rows, found = shingles(data, offsets, width)
                n, node = node_of(rows, found, len(keys))
                ids = batch.column(0).slice(done, len(keys))  # a null id would not survive as a number
                done += len(keys)
                yield pa.RecordBatch.from_arrays([ids, pa.array(keys), pa.array(n.astype(np.int64)), pa.array(node.view(np.int64))], ["doc_id", "row", "n", "node"])

    return docs.select("doc_id", "row", "text").mapInArrow(thrifty(run), "doc_id long, row long, n long, node long")


def thin(n: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Whether ``s`` of ``n`` shingles are so few that all of them may be missing from a set at
    similarity 4/5."""
    return s <= n - needed(n)


def _runs(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the runs of equal rows of sorted columns."""
    change = np.zeros(len(columns[0]), bool)
    change[:1] = True
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    head = np.flatnonzero(change)
    return head, np.diff(np.append(head, len(columns[0])))


def _send_lists(out: blobs.Out, keys: np.ndarray, node: np.ndarray, n: int) -> None:
    order = np.lexsort((node, keys))
    keys, node = keys[order], node[order]
    head, _ = _runs(keys, node)
    keys, node = keys[head], node[head]
    head, size = _runs(keys)
    full = np.repeat(size >= CAP, size)
    bucket = (keys % np.uint64(n)).astype(np.int64)
    key32 = (keys >> np.uint64(32)).astype(np.uint32)
    known = np.zeros(int(full.sum()), SHARE)
    known["node"], known["size"] = node[full], CAP
    known["key"] = (bucket[full].astype(np.uint64) << np.uint64(32)) | key32[full]
    _send_shares(out, known, n)
    first = np.zeros(len(keys), bool)
    first[head] = True
    sent = ~full | first
    entries = np.zeros(int(sent.sum()), LIST)
    entries["key"], entries["node"], entries["full"] = key32[sent], node[sent], full[sent]
    blobs.split_by(out, bucket[sent].astype(np.int32), entries)


def _send_shares(out: blobs.Out, shares: np.ndarray, n: int) -> None:
    """Keyed by the bucket of the node, for the next exchange; spread alike over this one."""
    blobs.by_key(out, 0, (mix(shares["node"]) % np.uint64(n)).astype(np.int64), shares, n)


def shared_lists(docs: DataFrame, width: int) -> DataFrame:
    """Keyed rows of SHARE records: each node's lists of two or more nodes, and its n and s."""
    n_of = blobs.n_buckets(docs)

    def index(batches):
        out, held, size = blobs.Out(), [], 0
        for keys, data, offsets in rows_of_text(batches, "row"):
            rows, found = shingles(data, offsets, width)
            n, node = node_of(rows, found, len(keys))
            infos = []
            few = thin(n, np.bincount(rows, sampled(found), minlength=len(keys)))
            families = ((0, (n <= SMALL) & (n > 0), 0), (1, n >= LARGE, 0x5851F42D4C957F2D), (2, (n >= LARGE) & few, 0x14057B7EF767814F))
            for family, fits, salt in families:
                take = fits[rows]
                if family == 1:
                    take &= sampled(found)
                s = np.bincount(rows[take], minlength=len(keys))
                info = np.zeros(int(fits.sum()), SHARE)
                info["node"] = node[fits] | np.uint64(family)
                info["key"] = n[fits].astype(np.uint64) | (s[fits].astype(np.uint64) << np.uint64(32))
                infos.append(info)
                held.append((mix(found[take] + np.uint64(salt)), node[rows[take]] | np.uint64(family)))
                size += int(take.sum())
            _send_shares(out, np.unique(np.concatenate(infos)), n_of)
            if size > BLOCK:
                _send_lists(out, *map(np.concatenate, zip(*held)), n_of)
                held, size = [], 0
            yield from out.take()
        if held:
            _send_lists(out, *map(np.concatenate, zip(*held)), n_of)
        yield from out.take(last=True)

    def meet(parts, out, bucket):
        entries = np.frombuffer(b"".join(parts), LIST)
        entries = entries[np.lexsort((~entries["full"], entries["node"], entries["key"]))]
        one, _ = _runs(entries["key"], entries["node"])
        entries = entries[one]
        head, size = _runs(entries["key"])
        size = np.where(np.maximum.reduceat(entries["full"], head) if len(head) else size, CAP, np.minimum(size, CAP))
        each = np.repeat(size, np.diff(np.append(head, len(entries))))
        told = (each > 1) & ~entries["full"]
        shares = np.zeros(int(told.sum()), SHARE)
        shares["node"], shares["size"] = entries["node"][told], each[told]
        shares["key"] = (np.uint64(bucket) << np.uint64(32)) | entries["key"][told].astype(np.uint64)
        _send_shares(out, shares, n_of)

    return blobs.reduce_buckets(docs.select("row", "text").mapInArrow(thrifty(index), blobs.SCHEMA), meet, n_of)


def short_lists(shares: np.ndarray) -> np.ndarray:
    """ENTRY records: the d + 1 shortest lists of each node that can link at all."""
    shares = shares[np.lexsort((shares["key"], shares["size"], shares["node"]))]
    one, _ = _runs(shares["node"], shares["size"], shares["key"])
    shares = shares[one]
    head, count = _runs(shares["node"])
    ok = shares["size"][head] == 0
    n = (shares["key"][head] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    s = (shares["key"][head] >> np.uint64(32)).astype(np.int64)
    if not ok.all():
        raise ValueError("a node came without its size")
    room = n - needed(n) + 1 - (s - (count - 1))  # short lists left after those of one node
    rank = np.arange(len(shares)) - np.repeat(head, count)
    chosen = (rank > 0) & (rank <= np.repeat(room, count))
    found = np.zeros(int(chosen.sum()), ENTRY)
    found["key"], found["node"] = shares["key"][chosen], shares["node"][chosen] & ~FAMILY
    # families have lists of their own
    found["key"] |= (shares["node"][chosen] & FAMILY) << np.uint64(62)
    return found


def _stars(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(EDGE records from each list's nodes to its least node, that node's entry)."""
    entries = entries[np.lexsort((entries["node"], entries["key"]))]
    head, size = _runs(entries["key"])
    first = np.repeat(entries["node"][head], size)
    out = entries["node"] != first
    a, b = first[out].view(np.int64), entries["node"][out].view(np.int64)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    one, lists = _runs(a, b)
    edges = np.zeros(len(one), EDGE)
    edges["a"], edges["b"], edges["lists"] = a[one], b[one], lists
    return edges, entries[head]


def candidate_edges(docs: DataFrame, width: int) -> DataFrame:
    """(a, b, lists): stars over the short lists, from their least nodes, and how many lists give an
    edge; linked nodes are in one component of these."""
    n = blobs.n_buckets(docs)

    def choose(parts, out, bucket):
        edges, firsts = _stars(short_lists(np.frombuffer(b"".join(parts), SHARE)))
        if len(edges):
            out.add(bucket, -1, edges.tobytes())
        blobs.by_key(out, bucket, (mix(firsts["key"]) % np.uint64(n)).astype(np.int64), firsts)

    def star(parts, out, bucket):
        edges, _ = _stars(np.frombuffer(b"".join(parts), ENTRY))
        if len(edges):
            out.add(bucket, -1, edges.tobytes())

    shares = shared_lists(docs, width)
    chosen = blobs.reduce_buckets(shares.select(F.col("key").cast("int").alias("bucket"), F.lit(None).cast("long").alias("key"), "data"), choose, n)
    kept = F.when(F.col("key") < 0, F.col("key"))
    lists = chosen.select(F.when(F.col("key") < 0, F.col("bucket")).otherwise(F.col("key")).cast("int").alias("bucket"), kept.alias("key"), "data")
    packed = blobs.reduce_buckets(lists, star, n)

    def unpack(batches):
        for batch in batches:
            edges = np.frombuffer(b"".join(batch.column(0).to_pylist()), EDGE)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(edges[c])) for c in EDGE.names], list(EDGE.names))

    return packed.select("data").mapInArrow(thrifty(unpack), "a long, b long, lists long").groupBy("a", "b").agg(F.sum("lists").alias("lists"))


class Links:
    """Union-find over the nodes of a block."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)


def divide_skip(pointer: np.ndarray, tokens: np.ndarray, labels: np.ndarray | None = None, sides: np.ndarray | None = None) -> Links:
    """Links among sets ``tokens[pointer[i]:pointer[i + 1]]``, which are in ascending size.  Sets of
    equal ``labels`` are known to be connected; with ``sides``, only sets of different sides are
    looked up.

    Set x is looked up among smaller sets and equals before it.  Its T - 1 longest lists are
    set aside; the others are merged, which counts how often each candidate occurs in them;
    a candidate that can reach the overlap is probed in the long lists by binary search."""
    n = len(pointer) - 1
    links = Links(n)
    if labels is not None:
        order = np.argsort(labels, kind="stable")
        for x, y in zip(order[:-1], order[1:]):
            if labels[x] == labels[y]:
                links.join(int(x), int(y))
    sizes = np.diff(pointer)
    names, ranks = np.unique(tokens, return_inverse=True)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(ranks * n + owner, kind="stable")
    postings = ranks[order] * n + owner[order]  # all lists, one after another, each sorted
    begin = np.searchsorted(ranks[order], np.arange(len(names) + 1))
    length = np.diff(begin)
    for x in range(1, n):
        mine = ranks[pointer[x] : pointer[x + 1]]
        mine = mine[np.argsort(length[mine], kind="stable")]
        least = int(needed(sizes[x]))
        short, long = mine[: len(mine) - least + 1], mine[len(mine) - least + 1 :]
        short = short[length[short] > 1]
        counts = length[short]
        at = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(begin[short], counts)
        seen = postings[at] % n
        seen = seen[(seen < x) & (sizes[seen] >= least)]
        if sides is not None:
            seen = seen[sides[seen] != sides[x]]
        if not len(seen):
            continue
        seen = np.sort(seen, kind="stable")  # timsort: it finds the sorted lists as runs and merges them
        head, times = _runs(seen)
        found = seen[head]
        for k in np.lexsort((found, -times)):
            y = int(found[k])
            if links.root(y) == links.root(x):
                continue
            want = int(-(-4 * (sizes[x] + sizes[y]) // 9))
            if times[k] + len(long) < want:
                continue
            probe = long * n + y
            where = np.searchsorted(postings, probe)
            hits = int((postings[np.minimum(where, len(postings) - 1)] == probe).sum())
            if times[k] + hits >= want:
                links.join(x, y)
    return links


def search(table: pa.Table, width: int) -> pa.Table:
    """(a, b): each node of a block (node, label, side, text) and the least node that it is connected
    with in the block; a block of two sides is searched across them."""
    _, one = np.unique(table.column("node").to_numpy(), return_index=True)  # a repeated row is one node
    table = table.take(pa.array(one))
    text = table.column("text").combine_chunks()
    node, label, side = (table.column(c).to_numpy() for c in ("node", "label", "side"))
    data, offsets = utf8(text if isinstance(text, pa.Array) else pa.concat_arrays(text.chunks))
    rows, found = shingles(data, offsets, width)
    size = np.bincount(rows, minlength=len(node))
    order = np.lexsort((node, size))
    begin = np.concatenate([[0], np.cumsum(size)])
    pointer = np.concatenate([[0], np.cumsum(size[order])])
    at = np.arange(int(pointer[-1])) - np.repeat(pointer[:-1], size[order]) + np.repeat(begin[:-1][order], size[order])
    links = divide_skip(pointer, found[at], label[order], side[order] if side.any() else None)
    node = node[order]
    root = np.array([links.root(i) for i in range(len(node))], np.int64)
    least = np.full(len(node), np.iinfo(np.int64).max)
    np.minimum.at(least, root, node)
    out = node != least[root]
    return pa.table({"a": pa.array(least[root][out]), "b": pa.array(node[out])})


def searched(blocks: DataFrame, sets: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(a, b): links within the blocks of (block, node, label, side)."""
    of = blocks.join(sets.select("node", "row"), "node").groupBy("row", "node").agg(F.collect_list(F.struct("block", "label", "side")).alias("blocks"))
    texts = docs.select("row", "text").join(of.hint("shuffle_hash"), "row")  # a text moves once, then as often as it has blocks
    rows = texts.select(F.explode("blocks").alias("at"), "node", "text").select("at.block", "at.label", "at.side", "node", "text")
    return rows.groupBy("block").applyInArrow(lambda table: search(table, width), "a long, b long")


def star_blocks(edges: DataFrame) -> DataFrame:
    """(block, node, label, side): each node with the centre that it shares most lists with."""
    best = edges.groupBy("b").agg(F.max_by("a", F.struct("lists", "a")).alias("a"))
    parts = best.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / STAR).cast("int").alias("parts"))
    leaves = best.join(parts, "a").select("a", "b", F.xxhash64("a", F.pmod(F.xxhash64("b"), F.col("parts"))).alias("block"))
    centres = leaves.select("block", F.col("a").alias("node")).distinct()
    return leaves.select("block", F.col("b").alias("node")).unionByName(centres).withColumns({"label": F.col("node"), "side": F.lit(0)})


def open_blocks(edges: DataFrame, settled: DataFrame, sets: DataFrame) -> DataFrame:
    """(block, node, label, side): pairs of cells of the groups that candidate edges between components
    leave open; ``settled`` has (vertex, root)."""
    label = lambda c: settled.select(F.col("vertex").alias(c), F.col("root").alias(f"r{c}"))
    ends = edges.select("a", "b").join(label("a"), "a", "left").join(label("b"), "b", "left")
    between = ends.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).filter("a <> b").distinct()
    groups = components(between).select(F.col("vertex").alias("label"), F.col("root").alias("group_id"))
    named = sets.join(settled.withColumnRenamed("vertex", "node"), "node", "left").select("node", "n", F.coalesce("root", "node").alias("label"))
    members = materialize(named.join(groups, "label"), "members")
    need = lambda: F.ceil(F.greatest(F.count(F.lit(1)) / PART_NODES, F.sum("n") / PART_SHINGLES)).cast("int")
    large = members.groupBy("group_id").agg(need().alias("whole")).filter("whole > 1").select("group_id")
    # sets that link differ in size by a quarter at most, so they are in one class or in neighbours
    sized = members.join(large.withColumn("large", F.lit(True)), "group_id", "left").withColumn(
        "size", F.when(F.col("large"), F.floor(F.log("n") / F.log(F.lit(1.26)))).otherwise(0).cast("int")
    )
    # a component of many nodes has cells of its own: nothing in it is left to be found
    many = sized.filter("large").groupBy("group_id", "size", "label").agg(need().alias("own")).filter("own > 1").drop("own")
    owned = sized.join(many.withColumn("owner", F.col("label")), ["group_id", "size", "label"], "left")
    owner = F.coalesce("owner", F.lit(-1))  # node ids are not negative
    parts = owned.groupBy("group_id", "size", owner.alias("owner")).agg(need().alias("parts"))
    cell = F.xxhash64("group_id", "size", "owner", F.pmod(F.xxhash64("node"), F.col("parts")))
    placed = materialize(
        owned.withColumn("owner", owner).join(parts, ["group_id", "size", "owner"]).select("group_id", "size", "owner", cell.alias("cell"), "node", "label"), "cells"
    )
    cells = placed.groupBy("group_id", "size", "owner", "cell").agg(F.lit(1).alias("one")).drop("one")
    other = cells.select("group_id", F.explode(F.array("size", F.col("size") - 1)).alias("size"), F.col("size").alias("their_size"), F.col("owner").alias("their_owner"), F.col("cell").alias("with"))
    pairs = cells.join(other, ["group_id", "size"]).filter(
        ((F.col("size") < F.col("their_size")) | (F.col("cell") <= F.col("with"))) & ((F.col("owner") < 0) | (F.col("owner") != F.col("their_owner")))
    )
    block = F.xxhash64("cell", "with").alias("block")
    ends = F.when(F.col("cell") == F.col("with"), F.array(F.struct("cell", F.lit(0).alias("side")))).otherwise(
        F.array(F.struct("cell", F.lit(0).alias("side")), F.struct(F.col("with").alias("cell"), F.lit(1).alias("side")))
    )
    blocks = pairs.select(block, F.inline(ends))
    return placed.select("cell", "node", "label").join(blocks, "cell").select("block", "node", "label", "side")


def link_components(docs: DataFrame, width: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id): the least doc_id that links reach."""
    docs = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    found = materialize(nodes(docs, width), "nodes")
    # a node's text is that of one of its rows; its least id is null where no row has one
    sets = materialize(
        found.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("first"), F.min("row").alias("row"), F.first("n").alias("n")), "sets"
    )
    edges = materialize(candidate_edges(docs, width), "candidates")
    release(docs.sparkSession)
    settled = components(searched(star_blocks(edges), sets, docs, width))
    release(docs.sparkSession)
    more = searched(open_blocks(edges, settled, sets), sets, docs, width)
    linked = components(settled.select(F.col("root").alias("a"), F.col("vertex").alias("b")).unionByName(more))
    label = sets.join(linked.withColumnRenamed("vertex", "node"), "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    label = materialize(label, "node-labels")
    least = label.groupBy("root").agg(F.min("first").alias("component_id"))
    by_node = label.join(least, "root").select("node", "component_id")
    return found.join(by_node, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )
