import random
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from brute import components, kept  # noqa: E402
from conftest import TEXTS, words  # noqa: E402

from tessella.llm import jaccard_join, substring_dedup  # noqa: E402
from tessella.llm.components import components as connected  # noqa: E402


def random_texts(seed, n=120):
    """Texts with copies, edits and shared passages out of a small vocabulary."""
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    passages = [[r.choice(vocabulary) for _ in range(r.randint(10, 60))] for _ in range(6)]
    texts = {}
    for i in range(n):
        if texts and r.random() < 0.4:
            w = texts[r.choice(list(texts))].split(" ")
            for _ in range(r.randint(0, max(1, len(w) // 30))):
                w[r.randrange(len(w))] = r.choice(vocabulary)
        else:
            w = [r.choice(vocabulary) for _ in range(r.choice([3, 12, 40, 150, 450, 700]))]
        if r.random() < 0.4:
            at = r.randrange(len(w) + 1)
            w[at:at] = r.choice(passages)
        texts[i] = " ".join(w)
    return texts


def test_substring_edges(docs, no_docs):
    want = kept({i: t for i, t in TEXTS.items()})
    out = substring_dedup.changed(docs)
    assert {"doc_id", "factors"} <= set(out.columns)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in out.collect()}
    assert got == {i: v for i, v in want.items() if v[1]}
    whole = substring_dedup.dedup_substrings(docs)
    assert whole.columns[:-1] == [c for c in docs.columns if c != "n_removed"] and whole.count() == docs.count()
    assert {r["doc_id"]: r["n_removed"] for r in whole.filter("doc_id is not null").collect()} == {i: v[1] for i, v in want.items()}
    assert substring_dedup.dedup_substrings(no_docs).count() == 0


def test_substring_rows_of_one_id(spark):
    """Long rows that repeat, and rows that share an id and differ in text, each keep their own."""
    a, b, c = (" ".join(words(k, 60)) for k in (71, 72, 73))
    rows = [(1, a), (2, a), (2, a), (2, f"{b} {a} tail"), (2, "short"), (3, f"{c} {b}"), (3, f"{b} more"), (3, None), (4, f"{c} {c}"), (4, f"{c} {c}"), (None, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    windows = lambda w: {tuple(w[p : p + 13]) for p in range(len(w) - 12)}
    want = []
    for i, text in rows:
        w = (text or "").split()
        known = set().union(*(windows((t or "").split()) for j, t in rows if i is not None and j is not None and j < i), set())
        gone = [any(tuple(w[p : p + 13]) in known for p in range(max(0, k - 12), k + 1)) for k in range(len(w))]
        kept = text if not any(gone) else " ".join(x for x, g in zip(w, gone) if not g)
        want.append((i, kept, sum(gone)))
    got = [tuple(r) for r in substring_dedup.dedup_substrings(df).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and sum(x[2] for x in want) > 300
    assert substring_dedup.changed(df).count() == 5  # equal rows once


def test_substring_random(spark):
    texts = random_texts(5)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r for r in substring_dedup.changed(df).collect()}
    want = kept(texts)
    assert {i: (r["n_words"], r["n_removed"], r["kept_sha256"]) for i, r in got.items()} == {i: v for i, v in want.items() if v[1]}
    for i, r in got.items():  # every factor is a copy from a smaller document
        for start, size, source, there in r["factors"]:
            assert source < i and texts[i].split(" ")[start : start + size] == texts[source].split(" ")[there : there + size]


def test_jaccard_edges(docs, no_docs):
    out = jaccard_join.link_components(docs).collect()
    assert len(out) == docs.count()
    texts = TEXTS | {-5: "two words"}  # the null id shares a set with 8 and 9
    want = components(texts)
    for r in out:
        if r["doc_id"] is None:
            assert r["component_id"] == 8
        elif r["doc_id"] in (8, 9):
            assert (r["n_shingles"], r["component_id"]) == (1, 8)
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
    assert jaccard_join.link_components(no_docs).count() == 0


def test_jaccard_null_ids_and_thin_samples(spark, monkeypatch):
    """Rows without an id have near copies and bridge others; sets with too few shingles in the
    sampled range are linked all the same."""
    w = words(81, 100)
    other = words(82, 600)
    texts = [(None, w), (5, [*w[:-1], "x"]), (7, [*w[3:], "a", "b"]), (None, words(83, 50)), (9, other), (4, [*other[:-1], "y"]), (None, [*other, "z"]), (6, words(84, 600))]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in texts], "doc_id long, text string").repartition(3)
    for rate in (jaccard_join.RATE, 1e-9):  # no set has a shingle in so small a range
        monkeypatch.setattr(jaccard_join, "RATE", rate)
        got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.link_components(df).collect()), key=repr)
        want = [(None, 96, 5), (5, 96, 5), (7, 95, 5), (None, 46, None), (9, 596, 4), (4, 596, 4), (None, 597, 4), (6, 596, 6)]
        assert got == sorted(want, key=repr)


@pytest.mark.parametrize("star, part", [(128, 128), (3, 5)])
def test_jaccard_random(spark, monkeypatch, star, part):
    monkeypatch.setattr(jaccard_join, "STAR", star)
    monkeypatch.setattr(jaccard_join, "PART_NODES", part)
    texts = random_texts(11, 150)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.link_components(df).collect()}
    assert got == components(texts)


def test_jaccard_settles_copies_before_it_searches(spark):
    """A large group of near copies is one component after the stars, so nothing of it is searched
    pair by pair; documents that share a passage but do not link stay open and apart."""
    r = random.Random(9)
    base, passage = words(91, 120), words(92, 30)
    texts = {}
    for i in range(400):
        w = list(base)
        w[r.randrange(120)] = f"x{r.randrange(60)}"
        texts[i] = " ".join(w)
    for i in range(400, 440):  # beside the passage, pairs of these share a little more
        texts[i] = " ".join(passage + words(200 + i // 2, 14))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    docs = jaccard_join.keyed(df)
    found = jaccard_join.nodes(docs)
    sets = found.groupBy("node").agg(F.min("doc_id").alias("first"), F.min("row").alias("row"), F.first("n").alias("n")).cache()
    edges = jaccard_join.candidate_edges(docs, 5).cache()
    blocks = jaccard_join.star_blocks(edges)
    assert blocks.groupBy("block").count().agg(F.max("count")).first()[0] < 2 * jaccard_join.STAR
    assert blocks.count() < 1.2 * sets.count()
    settled = connected(jaccard_join.searched(blocks, sets, docs, 5))
    left = jaccard_join.open_blocks(edges, settled, sets).join(sets, "node").agg(F.min("first")).first()[0]
    assert left is None or left >= 400
    assert {x["doc_id"]: x["component_id"] for x in jaccard_join.link_components(df).collect()} == {i: c for i, (_, c) in components(texts).items()}


def test_divide_skip():
    r = random.Random(3)
    sets = [sorted({r.randrange(60) for _ in range(r.randint(1, 40))}) for _ in range(40)]
    sets += [sorted({*s, 99}) for s in sets[:10]]
    sets.sort(key=len)
    pointer = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    links = jaccard_join.divide_skip(pointer, np.concatenate(sets).astype(np.uint64))
    up = list(range(len(sets)))
    root = lambda x: x if up[x] == x else root(up[x])
    for a in range(len(sets)):
        for b in range(a):
            both = len(set(sets[a]) & set(sets[b]))
            if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    assert [links.root(i) for i in range(len(sets))] == [root(i) for i in range(len(sets))]


def test_components(spark):
    path = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (7, 7)]
    got = {r["vertex"]: r["root"] for r in connected(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0
