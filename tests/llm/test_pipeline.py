import sys
import zlib
from pathlib import Path

import duckdb
import numpy as np

sys.path.insert(0, str(Path(__file__).parent))
from brute import components, kept  # noqa: E402
from conftest import words  # noqa: E402

import corpus_pipeline  # noqa: E402
from tessella.llm import common, decontamination, oracles, queries, toxicity  # noqa: E402
from tessella.llm.common import mark, materialize, table  # noqa: E402


def test_stages_against_brute_force(spark, tables):
    docs = table(spark, tables, "documents")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = materialize(stage(spark, docs, tables), name)
        after = {r["doc_id"]: r for r in out.collect()}
        assert out.columns == docs.columns and len(after) == out.count()
        if k == 0:
            model = toxicity.fit(docs, table(spark, tables, "labels"))
            read = toxicity.Reader()
            assert set(after) == {i for i, t in before.items() if model.severity(read(t or ""))[1] < model.cut}
        elif k == 1:
            assert set(after) == {i for i, (_, c) in components(before).items() if i == c}
        elif k == 2:
            want = kept(before)
            assert set(after) == set(before)
            assert all((after[i]["text"] != t) == (want[i][1] > 0) and after[i]["n_chars"] == len(after[i]["text"]) for i, t in before.items())
        else:
            bad = {r["doc_id"] for r in decontamination.contaminated(docs, table(spark, tables, "benchmark")).collect()}
            assert set(after) == set(before) - bad
        docs = out
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, tables).collect()
    check_packing(packed, [(r["doc_id"], r["text"]) for r in docs.collect()])


def check_packing(rows, texts, size=1024):
    """Every id of every document lies in one piece, and pieces lie gapless in their sequences."""
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, got, packs = [], [], {}
    for i, text in texts:
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 0]
        want += [(i, start, zlib.crc32(np.asarray(ids[start : start + size], "<u4").tobytes()), len(ids)) for start in range(0, len(ids), size)]
    for r in rows:
        got.append((r["doc_id"], r["start"], r["ids_crc32"], r["doc_tokens"]))
        packs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(got, key=repr) == sorted(want, key=repr)
    for pieces in packs.values():
        ends = [0, *(o + n for o, n in sorted(pieces))]
        assert [o for o, _ in sorted(pieces)] == ends[:-1] and ends[-1] <= size


def test_pipeline_edges(spark, docs, no_docs, tables, tmp_path):
    """Nulls, repeated rows, very long texts and clashing columns pass; empty tables do too."""
    def folder(name, documents, labels, benchmark):
        for table_name, df in (("documents", documents), ("labels", labels), ("benchmark", benchmark)):
            df.write.parquet(f"{tmp_path}/{name}/{table_name}.parquet")
        return f"{tmp_path}/{name}"

    bench = spark.createDataFrame([(1, " ".join(words(5, 30))), (2, None), (3, "")], "item_id long, text string")  # stands in document 11
    labels = spark.createDataFrame([(i, 1, 0) for i in (1, 4, 5)] + [(6, None, None), (999, 1, 1)], "doc_id long, quality int, toxic int")
    at = folder("edges", docs, labels, bench)
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = materialize(stage(spark, kept, at), name)
    left = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    after = components({i: t for i, t in texts.items() if i is not None})
    survivors = {i: texts[i] for i, (_, c) in after.items() if i == c}
    cut = kept_texts(survivors)
    want = [(i, t) for i, t in cut.items() if i != 11] + [(8, "Two words"), (None, "two words")]
    assert left == sorted(want, key=repr)
    check_packing(corpus_pipeline.run(spark, at).collect(), left)
    nothing = folder("nothing", no_docs, labels.limit(0), bench.limit(0))
    assert corpus_pipeline.run(spark, nothing).count() == 0
    bare = folder("bare", docs, labels.limit(0), bench.limit(0))
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, bare).collect()} == set(survivors) | {None}


def kept_texts(texts, window=13):
    """doc_id: text without the words of windows that a smaller document holds; untouched texts as they are."""
    out = {}
    for i, (_, removed, _) in kept(texts, window).items():
        if not removed:
            out[i] = texts[i]
            continue
        w = texts[i].split()
        known = {tuple(v[p : p + window]) for j, t in texts.items() if j < i for v in [(t or "").split()] for p in range(len(v) - window + 1)}
        out[i] = " ".join(x for k, x in enumerate(w) if not any(tuple(w[p : p + window]) in known for p in range(max(0, k - window + 1), k + 1)))
    return out


def test_scratch_tables_go_with_their_stage(spark, tables):
    point = mark()
    corpus_pipeline.run(spark, tables).count()
    left = [p.rpartition("/")[2].rsplit("-", 1)[0] for p in common._SCRATCH["paths"][point:]]
    assert left == ["benchmark_decontamination", "pieces"]


def test_queries_against_sql(spark, tables):
    con = duckdb.connect()
    for path in Path(tables).glob("*.parquet"):
        con.sql(f"create view {path.stem} as select * from '{path}'")
    for name, sql in oracles.ORACLES.items():
        got = queries.queries()[name](spark, tables)
        cols = sorted(got.columns)
        want = con.sql(f"select {', '.join(cols)} from ({sql}) q").fetchall()
        assert sorted((tuple(r) for r in got.select(*cols).collect()), key=repr) == sorted(want, key=repr), name
