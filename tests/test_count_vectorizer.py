import pytest
from pyspark.sql import functions as F

from tessella.functions.patterns import to_java
from tessella.operators import count_vectorizer as cv
from tessella.plans import harness

TOY = ["Rain falls on the harbour wall.", "The harbour, the harbour light.", "One wall of rain and ONE of wind.", "Falls the light on rain?"]
WORDS = "and falls harbour light of on one rain the wall wind".split()
CELLS = {0: {1: 1, 2: 1, 5: 1, 7: 1, 8: 1, 9: 1}, 1: {2: 2, 3: 1, 8: 2}, 2: {0: 1, 4: 2, 6: 2, 7: 1, 9: 1, 10: 1}, 3: {1: 1, 3: 1, 5: 1, 7: 1, 8: 1}}


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def cells(triplets):
    out = {}
    for r in triplets.collect():
        out.setdefault(r[0], {})[r["idx"]] = r["count"]
    return out


def vocabulary(v):
    return [r["token"] for r in v.orderBy("idx").collect()]


def test_toy(spark):
    df = docs(spark, TOY)
    v, t = cv.cv_fit_transform(df)
    assert vocabulary(v) == WORDS and cells(t) == CELLS
    assert [r["idx"] for r in v.orderBy("idx").collect()] == list(range(11))
    assert cells(cv.cv_transform(df, cv.cv_fit(df))) == CELLS
    assert [r["indptr"] for r in cv.indptr(df, t).orderBy("doc_id").collect()] == [6, 9, 15, 20]
    assert [r["indptr"] for r in cv.running_ends(cv.row_sizes(df)).orderBy("doc_id").collect()] == [6, 9, 15, 20]


def test_empty_rows_unknown_tokens_and_empty_corpus(spark):
    df = docs(spark, ["alpha beta", "", "a b c", None])
    v, t = cv.cv_fit_transform(df)
    rows = cv.csr_rows(df, t).orderBy("doc_id").collect()
    assert [list(r["indices"]) for r in rows] == [[0, 1], [], [], []]
    assert cells(cv.cv_transform(docs(spark, ["beta gamma beta"]), v)) == {0: {1: 2}}
    assert cv.cv_fit(docs(spark, ["x"]).limit(0)).count() == 0


def test_stop_words(spark):
    df = docs(spark, TOY)
    assert "the" not in vocabulary(cv.cv_fit(df, stop_words=["the"]))
    assert "the" in vocabulary(cv.cv_fit(df, stop_words=["The"]))
    assert vocabulary(cv.cv_fit(df, stop_words="english")) == WORDS


def test_unicode_and_patterns(spark):
    df = docs(spark, ["naïve café é1 b_c 日本語 ΑΣ 1a"])
    assert vocabulary(cv.cv_fit(df)) == sorted(["naïve", "café", "é1", "b_c", "日本語", "ας", "1a"], key=lambda w: w.encode())
    assert vocabulary(cv.cv_fit(df, token_pattern=r"(?u)\b\w\w+\b ?")) != []
    for bad in ("(", r"(?=a)b", r"(?<!a)b", r"(a)\1", r"(?>a)b", r"(?<n>a)\k<n>", "a++", "a{2}+", r"(?P=n)", r"\Qa\E", "(?P<n>a"):
        with pytest.raises(ValueError):
            cv.cv_fit(df, token_pattern=bad)
    assert to_java(r"\w+") == r"(?U)\w+"
    good = {r"(?P<a_b>[a-z]+)\d": ["x1", "y2"], r"(?<n>y)2": ["y2"], r"[]+]+": ["]+"], r"\++": ["+"], r"(?i)X\d": ["x1"], r"z+?": ["z"], r"(?:y|x)\d": ["x1", "y2"]}
    for pattern, found in good.items():
        assert vocabulary(cv.cv_fit(docs(spark, ["x1 y2 ]+ z"]), token_pattern=pattern)) == found, pattern


def test_limits_binary_ngrams(spark):
    df = docs(spark, TOY)
    assert vocabulary(cv.cv_fit(df, min_df=2)) == ["falls", "harbour", "light", "on", "rain", "the", "wall"]
    assert vocabulary(cv.cv_fit(df, max_features=2)) == ["harbour", "the"]  # rain is as frequent, and later
    assert vocabulary(cv.cv_fit(df, max_df=1)) == ["and", "of", "one", "wind"] and vocabulary(cv.cv_fit(df, max_df=0.5)) == [w for w in WORDS if w not in ("rain", "the")]
    assert vocabulary(cv.cv_fit(df.filter("doc_id <> 2"), min_df=1.0)) == ["the"]
    assert vocabulary(cv.cv_fit_transform(df, max_df=1)[0]) == ["and", "of", "one", "wind"]
    assert cells(cv.cv_fit_transform(df, binary=True)[1])[1][2] == 1
    assert "harbour wall" in vocabulary(cv.cv_fit(df, ngram_range=(2, 2)))
    assert vocabulary(cv.cv_fit(docs(spark, ["one"]), ngram_range=(2, 2))) == []


def test_estimator(spark):
    df = docs(spark, TOY)
    model = cv.CountVectorizer()
    assert cells(model.fit_transform(df)) == CELLS and cells(model.fit(df).transform(df)) == CELLS
    assert model.inverse_transform(model.transform(df)).filter("doc_id = 0").first()["tokens"] == ["falls", "harbour", "on", "rain", "the", "wall"]
    with pytest.raises(ValueError):
        cv.CountVectorizer(n_jobs=0)
    with pytest.raises(ValueError):
        cv.CountVectorizer().transform(df)


def test_fixed_vocabulary_params_and_metrics(spark):
    df = docs(spark, TOY)
    model = cv.CountVectorizer(vocabulary=["rain", "harbour", "no"])
    assert cells(model.fit_transform(df)) == {0: {0: 1, 1: 1}, 1: {1: 2}, 2: {0: 1}, 3: {0: 1}} == cells(model.fit(df).transform(df))
    assert [r["token"] for r in model.get_feature_names_out().collect()] == ["rain", "harbour", "no"]
    given = cv.cv_fit(df.filter("doc_id = 1"))
    assert vocabulary(cv.CountVectorizer(vocabulary=given).fit(df).vocabulary_) == ["harbour", "light", "the"]
    model = cv.CountVectorizer(min_df=2)
    assert model.get_params()["min_df"] == 2 and model.set_params(min_df=1, n_jobs=3).get_params()["n_jobs"] == 3
    assert model.fit(df).vocabulary_.count() == 11
    assert model.metrics == {"documents": 4, "characters": sum(map(len, TOY))}
    for bad in ({"colour": 1}, {"n_jobs": 0}):
        with pytest.raises(ValueError):
            model.set_params(**bad)


def test_builders_analyzers_accents(spark):
    df = docs(spark, ["Crème BRÛLÉE ½ ok", "a", None])
    model = cv.CountVectorizer(strip_accents="unicode", stop_words=["ok"])
    shown = df.select(model.build_preprocessor()(F.col("text")), model.build_tokenizer()(F.col("text")), model.build_analyzer()(F.col("text"))).collect()
    assert tuple(shown[0]) == ("Creme BRULEE ½ ok", ["Crème", "BRÛLÉE", "ok"], ["creme", "brulee"]) and shown[1][2] == [] and shown[2][0] is None
    assert vocabulary(cv.cv_fit(df, strip_accents="ascii", lowercase=False)) == ["BRULEE", "Creme", "ok"]
    assert vocabulary(cv.cv_fit(docs(spark, ["ab  c😀d"]), analyzer="char", ngram_range=(2, 3))) == sorted(["ab", "b ", " c", "c😀", "😀d", "ab ", "b c", " c😀", "c😀d"], key=lambda w: w.encode())
    assert vocabulary(cv.cv_fit(docs(spark, ["ab c"]), analyzer="char_wb", ngram_range=(3, 4))) == [" ab", " ab ", " c ", "ab "]
    assert df.select(model.decode(F.encode("text", "utf-8"))).first()[0].startswith("Crème")
    for bad in ({"analyzer": "line"}, {"strip_accents": "x"}, {"analyzer": "char", "ngram_range": (0, 1)}):
        with pytest.raises(ValueError):
            cv.cv_fit(df, **bad)


def test_blocks_do_not_change_ids(spark):
    """Tokens that share a long prefix and sparse ids: blocks have many rows and ids stay dense."""
    texts = [" ".join(f"prefix_of_all_{k * 37 % 1000:05d}" for k in range(i, i + 40)) for i in range(0, 900, 30)]
    df = spark.createDataFrame([(i * 10**12 - 7, t) for i, t in enumerate(texts)] + [(None, "one more")], "doc_id long, text string")
    v, t = cv.cv_fit_transform(df)
    want = sorted({w for x in texts for w in x.split()} | {"one", "more"})
    assert [(r["token"], r["idx"]) for r in v.orderBy("idx").collect()] == [(w, k) for k, w in enumerate(want)]
    ends = [r["indptr"] for r in cv.running_ends(cv.row_sizes(df)).orderBy("doc_id").collect()]
    assert ends == [2 + 40 * k for k in range(len(texts) + 1)] and t.count() == ends[-1]
    counts, bounds = cv.token_counts(df), cv.token_bounds(df)
    assert len(bounds) > 50 and vocabulary(cv.vocabulary_of(counts, [])) == vocabulary(cv.vocabulary_of(counts, bounds)) == want


def test_counting_moves_texts_once(spark, tables):
    """One exchange for documents, none for (document, token) rows."""
    rows = spark.read.parquet(f"{tables}/documents.parquet")
    plan = cv.token_counts(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "ReadSchema: struct<doc_id:bigint,text:string>" in cv.token_counts(rows)._jdf.queryExecution().toString()
    assert "exchange" not in cv.row_sizes(rows)._jdf.queryExecution().optimizedPlan().toString().lower()


def csr_of(df):
    return cv.csr_rows(df, cv.cv_fit_transform(df)[1])


def made(df):
    """The plan that ran, without initial plans of stages."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_csr_rows_read_and_cut_texts_once(spark, tables):
    """The texts are scanned and matched once."""
    plan = made(csr_of(spark.read.parquet(f"{tables}/documents.parquet")))
    assert plan.count("struct<doc_id:bigint,text:string>") == 1 and plan.count("regexp_extract_all") == 1
    assert "hashpartitioning(token" not in plan


def test_csr_rows_of_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(1, "b a a"), (1, "aa bb aa"), (None, "cc aa"), (2, None), (3, ""), (4, "aa " * 300 + "dd")], "doc_id long, text string")
    rows = [(r["doc_id"], r["indices"], r["data"]) for r in csr_of(df).collect()]
    two = (1, [0, 1], [2, 1])
    assert sorted(rows, key=repr) == sorted([two, two, (None, [], []), (2, [], []), (3, [], []), (4, [0, 3], [300, 1])], key=repr)


def test_fit_transform_matches_texts_once(spark, tables):
    """No row of (document, token) is exchanged or sorted, and no text is matched twice."""
    plan = made(cv.cv_fit_transform(spark.read.parquet(f"{tables}/documents.parquet"))[1])
    assert plan.count("regexp_extract_all") == 1 and "SortMergeJoin" not in plan and "hashpartitioning(token" not in plan


def test_fit_transform_of_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(1, "bb aa"), (1, "aa"), (None, "cc aa"), (2, None)], "doc_id long, text string")
    v, t = cv.cv_fit_transform(df)
    assert vocabulary(v) == ["aa", "bb", "cc"] and cells(t) == {1: {0: 2, 1: 1}, None: {0: 1, 2: 1}} == cells(cv.cv_transform(df, v))
    assert cells(cv.cv_fit_transform(df, ngram_range=(1, 2), n_jobs=3)[1]) == {1: {0: 2, 1: 1, 2: 1}, None: {0: 1, 3: 1, 4: 1}}


def test_difference(spark):
    a, b = docs(spark, ["one two"]), docs(spark, ["two three"])
    assert {(r[0], r[1]) for r in harness.vocabulary_difference(cv.cv_fit(a), cv.cv_fit(b)).collect()} == {("one", "left"), ("three", "right")}
    assert harness.sparse_unequal(cv.token_counts(a), cv.token_counts(b), ["doc_id", "token"]).first()["n"] == 2
