"""Benchmark decontamination by spaced-seed hashing.  DataFrame functions only.

Texts are lower-cased; everything but letters and digits separates tokens.  A mask is a
run of positions of which some are ignored, so a hash over its kept positions survives
substitutions at the others.  Masks are chosen by window size such that every allowed
pattern of disagreeing positions leaves some placed mask whole, so no qualifying window is
without a seed.  Seed hashes of all benchmark positions are joined with those
of all document positions; around each hit document and item are laid along each other and
the item is leaked where some ``reach`` aligned tokens (all of a shorter item's) agree in
at least ``share``.

Seed rows hold numbers only: a hash, a row key and a place.  Hits are reduced to distinct
(document, item, shift) in each task before they are shuffled, written, and only then meet
tokens again: those of documents with a hit, and of items.  So a text is read a second time
where it has a hit and never stands beside each of its seeds.  Seeds of the benchmark have a
fixed width, so their count bounds their bytes; up to ``most_broadcast`` bytes they are
broadcast, else they are joined by shuffle, where Spark splits a hot seed.

Edge cases: null or empty texts have no tokens and never match; items too short for
a substitution are matched by their whole token run; repeated rows of a document count once,
and rows of one doc_id with several texts are one document; repeated items count each; a null
doc_id is reported as null; a text of any length is searched whole; of equal overlaps of a
document and an item the counts are the same, so ties need no order; empty tables give no row;
other columns, whatever their names, are ignored by ``leaks`` and kept by ``decontaminate``.
"""

from __future__ import annotations

import math
from functools import lru_cache
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import materialize

SEED_BYTES = 48  # of a benchmark seed in a hash table: three longs and their headers
#: Seed masks taken first; 1 is a kept position, 0 an ignored one.
MASKS = ("11011011", "1110010111", "110100110011")


def tokens(text: Column) -> Column:
    """A text that begins with other characters, or has no tokens, begins with an empty
    string, which is no token of an item."""
    return F.split(F.lower(text), r"[^\p{L}\p{N}]+")


def _placed(mask: str, window: int) -> list[int]:
    """Kept positions, as bits, of ``mask`` at each place within a window."""
    kept = sum(1 << k for k, bit in enumerate(mask) if bit == "1")
    return [kept << k for k in range(window - len(mask) + 1)]


@lru_cache(maxsize=None)
def masks_of(window: int, lost: int) -> tuple[str, ...]:
    """Masks of which one is whole at some place, whichever ``lost`` positions of a window
    disagree: those of MASKS that help, then the ones that reach most patterns left over."""
    if lost == 0:
        return ("1" * min(window, max(map(len, MASKS))),)
    weight = max(1, min(6, window - max(lost, window // 3)))
    if math.comb(window, lost) * math.comb(window, weight) > 500_000:  # too many to enumerate
        return ("1" * -(-(window - lost) // (lost + 1)),)  # some run between lost positions is as long
    left = {sum(1 << k for k in at) for at in combinations(range(window), lost)}
    reached = lambda m: {x for x in left if any(not x & place for place in _placed(m, window))}
    chosen = []
    for mask in MASKS:
        if found := reached(mask):
            chosen.append(mask)
            left -= found
    shapes = {"".join("01"[k in at] for k in range(at[0], at[-1] + 1)) for at in combinations(range(window), weight)}
    while left:
        best = max(sorted(shapes), key=lambda m: len(reached(m)))
        chosen.append(best)
        left -= reached(best)
    return tuple(chosen)


def _seed(words: Column, at: Column, mask: str) -> Column:
    """Hash of the kept positions of ``mask`` laid at ``at``; null past the end."""
    kept = [F.get(words, at + k) for k, bit in enumerate(mask) if bit == "1"]
    return F.when(at + len(mask) <= F.size(words), F.xxhash64(F.lit(mask), *kept))


def seeds(rows: DataFrame, masks: tuple[str, ...]) -> DataFrame:
    """(key, at, seed): one row per position and mask of ``rows`` (key, words)."""
    placed = rows.filter(F.size("words") > 0).withColumn("at", F.explode(F.sequence(F.lit(0), F.size("words") - 1)))
    hashes = F.array(*(_seed(F.col("words"), F.col("at"), m) for m in masks))
    return placed.select("key", "at", F.explode(hashes).alias("seed")).filter("seed is not null")


def _hits(docs: DataFrame, items: DataFrame, masks_by_window: dict[int, tuple[str, ...]], window: Column, most_broadcast: int) -> DataFrame:
    """(doc, item, shift): where a document and an item share a seed; shift is the place of the
    item's first token in the document."""
    known = seeds(items.limit(0), ("1",))
    for n, some in masks_by_window.items():
        known = known.unionByName(seeds(items.filter(window == n), some))
    known = known.select(F.col("key").alias("item"), F.col("at").alias("item_at"), "seed").distinct()
    if known.count() * SEED_BYTES <= most_broadcast:
        known = F.broadcast(known)
    masks = tuple(sorted({m for some in masks_by_window.values() for m in some}))
    there = seeds(docs, masks or ("1",))
    return there.join(known, "seed").select(F.col("key").alias("doc"), "item", (F.col("at") - F.col("item_at")).alias("shift")).distinct()


def leaks(docs: DataFrame, benchmark: DataFrame, reach: int = 13, share: float = 0.8, most_broadcast: int = 48_000_000) -> DataFrame:
    """(doc_id, item_id, matched, item_tokens): leaked items; matched: most aligned tokens that agree."""
    # keys are hashes of whole rows: rows that share one by chance are told apart by their tokens
    key = lambda c: F.xxhash64(F.lit(c), F.col(c).isNull(), c, "text")
    words = F.filter(tokens(F.col("text")), lambda w: w != "")
    items = benchmark.select("item_id", key("item_id").alias("key"), words.alias("words")).filter(F.size("words") > 0)
    # at most ``reach`` distinct window sizes
    window = F.least(F.lit(reach), F.size("words"))
    sizes = items.select(window.alias("window"), F.ceil(window * share).cast("int").alias("needed")).distinct().collect()
    masks = {r["window"]: masks_of(r["window"], r["window"] - max(r["needed"], 1)) for r in sizes if r["needed"] <= r["window"]}
    # a generator's output is a value: tokens are not computed again for each position
    texts = docs.select("doc_id", key("doc_id").alias("key"), "text")
    split = lambda rows: rows.select("doc_id", "key", F.explode(F.array(tokens(F.col("text")))).alias("words"))
    hits = materialize(_hits(split(texts), items, masks, window, most_broadcast), "seed-hits")
    # from here on sizes are those of written tables, and the planner chooses the joins by them
    with_hits = split(texts.join(hits.select(F.col("doc").alias("key")).distinct(), "key", "left_semi"))
    pairs = hits.join(items.select("item_id", F.col("key").alias("item"), F.col("words").alias("item_words")), "item")
    laid = with_hits.join(pairs, with_hits["key"] == pairs["doc"])
    size = F.size("item_words")
    same = F.transform(
        F.sequence(F.lit(0), size - 1),
        lambda k: F.when(F.col("shift") + k >= 0, F.get("words", F.col("shift") + k) == F.get("item_words", k)).otherwise(F.lit(False)),
    )
    agree = F.transform(same, lambda x: F.coalesce(x, F.lit(False)).cast("int"))
    # likewise the agreement of a hit is a value before its windows are added up
    counted = laid.select("doc_id", "item_id", size.alias("size"), F.explode(F.array(agree)).alias("agree"))
    window = F.least(F.lit(reach), F.col("size"))  # of a hit
    matched = F.aggregate("agree", F.lit(0), lambda a, b: a + b)
    some = counted.withColumn("matched", matched).filter(F.col("matched") >= F.ceil(window * share))
    best = F.array_max(
        F.transform(F.sequence(F.lit(0), F.col("size") - window), lambda k: F.aggregate(F.slice("agree", k + 1, window), F.lit(0), lambda a, b: a + b))
    )
    close = some.filter(best >= F.ceil(window * share))
    return close.groupBy("doc_id", "item_id").agg(F.max("matched").cast("long").alias("matched"), F.max("size").cast("long").alias("item_tokens"))


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(doc_id,) of documents with at least one leaked item."""
    return leaks(docs, benchmark, **options).select("doc_id").distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without those that leak an item; a null doc_id stays.  The ids are written first,
    so the planner sees how many they are and moves no text where they are few."""
    bad = materialize(contaminated(docs, benchmark, **options).filter("doc_id is not null"), "contaminated")
    return docs.join(bad, "doc_id", "left_anti")
