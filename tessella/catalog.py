"""Registered queries over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import count_vectorizer as cv
from tessella.operators import minmax as mm
from tessella.plans import harness
from tessella.sources import files

COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
STOPS = ["the", "de", "la"]
EN, ES = "lang = 'en'", "lang = 'es'"
RUNS = r"[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]{2,}"


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def minmax_fit(spark, d):
    return mm.minmax_fit(_t(spark, d, "lineitem"), COLS)


def minmax_fit_transform(spark, d):
    return mm.minmax_fit_transform(_t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *COLS), COLS)


def minmax_transform_new_data(spark, d):
    rows = _t(spark, d, "lineitem")
    stats = mm.minmax_fit(rows.filter("l_returnflag = 'A' and l_quantity < 30"), COLS)
    return mm.minmax_transform(rows.select("l_orderkey", "l_linenumber", *COLS), stats, COLS)


def minmax_constant_column(spark, d):
    rows = _t(spark, d, "lineitem").select("l_orderkey", F.lit(5.0).alias("constant"), "l_tax")
    return mm.minmax_fit_transform(rows, ["constant", "l_tax"])


def _holed(spark, d):
    value = F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return _t(spark, d, "events").select("event_id", value.alias("value"))


def minmax_nan(spark, d):
    """NaN is told from null: it is shown as the kind of a value."""
    holed = _holed(spark, d).withColumn("value", F.when(F.col("event_id") % 11 != 0, F.col("value")))
    out = mm.minmax_fit_transform(holed, ["value"])
    kind = F.when(F.col("value").isNull(), "null").when(F.isnan("value"), "nan").otherwise("number")
    return out.select("event_id", kind.alias("kind"), F.when(~F.isnan("value"), F.col("value")).alias("value"))


def minmax_range_clip(spark, d):
    """Null quantities stay null, whatever the range."""
    rows = _t(spark, d, "lineitem").withColumn("l_quantity", F.when(F.col("l_linenumber") != 3, F.col("l_quantity")))
    stats = mm.minmax_fit(rows.filter("l_quantity < 30"), ["l_quantity"])
    return mm.minmax_transform(rows.select("l_orderkey", "l_linenumber", "l_quantity"), stats, ["l_quantity"], feature_range=(-1, 1), clip=True)


def minmax_inverse(spark, d):
    """Values that were not scaled before: shares back in the range of another column."""
    stats = mm.minmax_fit(_t(spark, d, "part").select(F.col("p_retailprice").alias("l_discount")), ["l_discount"])
    rows = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_discount")
    return mm.minmax_inverse(rows, stats, ["l_discount"])


def minmax_empty(spark, d):
    """No rows, a column of NaN and one of nulls have no extremes."""
    rows = _t(spark, d, "events").select("event_id", F.lit(float("nan")).alias("nan"), F.lit(None).cast("double").alias("null"), "value")
    none = mm.minmax_fit(rows.filter("event_id < 0").select("value"), ["value"])
    show = lambda c: F.col(c).cast("string").alias(c)
    return none.unionByName(mm.minmax_fit(rows, ["nan", "null"])).select("feature", show("data_min"), show("data_max"))


def minmax_constant_other_value(spark, d):
    """A constant column gives 0 for every value, also for one that was not fitted."""
    stats = mm.minmax_fit(_t(spark, d, "lineitem").filter("l_quantity = 7"), ["l_quantity"])
    return mm.minmax_transform(_t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), stats, ["l_quantity"])


def minmax_dealt(spark, d):
    """Many partitions, or few: the statistics are the same."""
    return mm.minmax_fit(_t(spark, d, "lineitem").repartition(13), COLS)


def minmax_merge_stats(spark, d):
    rows = _t(spark, d, "orders")
    parts = [mm.minmax_fit(rows.filter(F.col("o_orderstatus") == s), ["o_totalprice"]) for s in ("F", "O", "P")]
    return mm.merge_stats(*parts)


def minmax_array_fit(spark, d):
    return mm.array_fit(_t(spark, d, "embeddings"), "embedding")


def minmax_array_fit_transform(spark, d):
    rows = _t(spark, d, "embeddings").select("vec_id", "embedding")
    out = mm.array_transform(rows, mm.array_fit(rows, "embedding"), "embedding")
    return out.select("vec_id", F.posexplode("embedding").alias("pos", "scaled"))


def tokenize(spark, d):
    return cv.tokenize(_t(spark, d, "documents")).groupBy("token").agg(F.count(F.lit(1)).alias("occurrences"))


def cv_fit(spark, d):
    return cv.cv_fit(_t(spark, d, "documents"))


def cv_fit_transform(spark, d):
    return cv.cv_fit_transform(_t(spark, d, "documents"))[1]


def cv_transform_unseen(spark, d):
    vocabulary = cv.cv_fit(_t(spark, d, "documents").filter("lang = 'en'"))
    rows = _t(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"), "text")
    return cv.cv_transform(rows, vocabulary, id_col="row_id")


def cv_stop_words(spark, d):
    return cv.cv_fit(_t(spark, d, "documents"), stop_words=STOPS)


def cv_token_pattern(spark, d):
    return cv.cv_fit_transform(_t(spark, d, "documents"), token_pattern=r"[a-z]{4,}")[1]


def cv_document_frequency(spark, d):
    return cv.cv_fit(_t(spark, d, "documents"), min_df=3, max_df=0.5, max_features=500)


def cv_binary(spark, d):
    return cv.cv_fit_transform(_t(spark, d, "benchmark"), id_col="item_id", binary=True)[1]


def cv_bigrams(spark, d):
    return cv.cv_fit(_t(spark, d, "benchmark"), id_col="item_id", ngram_range=(1, 2))


def cv_csr_rows(spark, d):
    docs = _t(spark, d, "documents")
    rows = cv.csr_rows(docs, cv.cv_fit_transform(docs)[1])
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return rows.select("doc_id", text("indices").alias("indices"), text("data").alias("data"))


def cv_indptr(spark, d):
    return cv.running_ends(cv.row_sizes(_t(spark, d, "documents")))


def cv_indptr_of_triplets(spark, d):
    """Documents fitted on another vocabulary: a row's size is that of its known tokens."""
    rows = _t(spark, d, "benchmark")
    return cv.indptr(rows, cv.cv_transform(rows, cv.cv_fit(_t(spark, d, "documents").filter("lang = 'en'")), id_col="item_id"), id_col="item_id")


def cv_inverse(spark, d):
    rows = _t(spark, d, "benchmark")
    vocabulary, triplets = cv.cv_fit_transform(rows, id_col="item_id")
    return cv.inverse_transform(triplets, vocabulary, "item_id").select("item_id", F.array_join("tokens", " ").alias("tokens"))


def cv_max_df_one(spark, d):
    """1 is a number of documents: tokens of one document only."""
    return cv.cv_fit(_t(spark, d, "benchmark"), id_col="item_id", max_df=1)


def cv_min_df_all(spark, d):
    """1.0 is a share: tokens that all rows have."""
    return cv.cv_fit(_t(spark, d, "documents").filter("lang = 'en' and n_chars > 6000"), min_df=1.0)


def cv_fixed_vocabulary(spark, d):
    rows = _t(spark, d, "benchmark")
    return cv.CountVectorizer(id_col="item_id", vocabulary={"the": 0, "of": 1, "no such": 2}).fit_transform(rows)


def cv_char_grams(spark, d):
    return cv.cv_fit_transform(_t(spark, d, "benchmark"), id_col="item_id", analyzer="char", ngram_range=(3, 3))[1]


def cv_case_kept(spark, d):
    return cv.cv_fit(_t(spark, d, "benchmark"), id_col="item_id", lowercase=False)


def vocab_difference(spark, d):
    docs = _t(spark, d, "documents")
    return harness.vocabulary_difference(cv.cv_fit(docs.filter("lang = 'en'")), cv.cv_fit(docs.filter("lang = 'es'")))


def sparse_unequal(spark, d):
    """Turns of users against those of assistants, by conversation and token."""
    turns = _t(spark, d, "conversations")
    side = lambda role: cv.token_counts(turns.filter(F.col("role") == role), "conv_id")
    return harness.sparse_unequal(side("user"), side("assistant"), ["conv_id", "token"])


def label_mean(spark, d):
    rows = harness.label_column(_t(spark, d, "events"), "event_type", {"click": "c", "view": "v"}, "other")
    return harness.group_mean(rows, ["label"], ["value"]).select("label", F.round("value", 6).alias("value"))


def _log(spark, d):
    """A log of the harness, made of orders: a record per priority, a line per status."""
    rows = _t(spark, d, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.min("o_custkey").alias("c"))
    lines = F.concat(F.lit("fit_"), F.lower("o_orderstatus"), F.lit(": "), F.col("n"), F.lit(" ms"))
    one = rows.groupBy("o_orderpriority").agg(F.sort_array(F.collect_list(lines)).alias("l"), F.min("c").alias("c"))
    head = F.concat(F.lit("{'Config': {'n_unique_words': "), F.col("c"), F.lit(", 'dataset_length': "), F.substring("o_orderpriority", 1, 1), F.lit("}}"))
    whole = F.array_join(F.concat(F.array(head), F.col("l"), F.array(F.lit(""), F.lit("# end"))), "\n")
    return one.select("o_orderpriority", whole.alias("text"))


def _lines(texts, *columns):
    return texts.select(*columns, F.posexplode(F.split("text", "\n")).alias("line_no", "value"))


def log_records(spark, d):
    """Records of a log without a start marker, with their settings as columns."""
    whole = _log(spark, d).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderpriority", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return files.wide(files.parse_log(_lines(whole)), ["fit_f", "fit_o", "fit_p"], ["n_unique_words", "dataset_length"])


def log_after_marker(spark, d):
    """What stands before the marker, even on its line, does not count."""
    whole = _log(spark, d).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderpriority", "text"))), lambda x: x["text"]), f"\nwarm up\nx {files.START} ").alias("text"))
    return files.wide(files.parse_log(_lines(whole)), ["fit_f", "fit_o", "fit_p"]).drop("record")


def first_fields(spark, d):
    """Lines of the comma-joined rows of a table, cut at the first comma."""
    lines = _t(spark, d, "nation").select(F.concat_ws(",", "n_name", "n_nationkey", "n_regionkey").alias("value"))
    return files.first_field(lines)


def csv_round_trip(spark, d):
    """A table written as CSV and read again, in the folder that all executors share."""
    path = files.shared_path(spark, "csv")
    files.write_csv(_t(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal"), path)
    return files.read_csv(spark, path, "s_suppkey bigint, s_name string, s_acctbal double")


def overhead_columns(spark, d):
    rows = _t(spark, d, "lineitem").groupBy("l_returnflag").agg(F.sum("l_quantity").alias("total"), (F.sum("l_quantity") + F.sum("l_linenumber")).alias("inner"), (F.sum("l_quantity") + 3 * F.sum("l_linenumber")).alias("outer"))
    return harness.overhead_columns(rows, "outer", "inner", "total").select("l_returnflag", "outer_overhead", "call_overhead", "outer_overhead_share")


def lookup_default(spark, d):
    """Least balance of a nation's suppliers; nations without one are told by a flag."""
    keys = _t(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"))
    out = harness.lookup(_t(spark, d, "supplier").filter("s_acctbal > 2000"), keys, ["s_nationkey"], "s_acctbal")
    return out.select("s_nationkey", F.isnan("s_acctbal").alias("absent"), F.when(~F.isnan("s_acctbal"), F.col("s_acctbal")).alias("s_acctbal"))


def affix_columns(spark, d):
    rows = _t(spark, d, "orders")
    return rows.select(*harness.with_affixes(rows, "o_order", without="date"))


def close_pairs(spark, d):
    """Prices that a change in the seventh place leaves equal within tolerance."""
    price = F.col("p_retailprice")
    other = F.when(F.col("p_partkey") % 3 == 0, price * (1 + 1e-7)).when(F.col("p_partkey") % 3 == 1, price * (1 + 1e-5)).otherwise(F.lit(float("nan")))
    return _t(spark, d, "part").select("p_partkey", harness.close(price, other).alias("same"))


def paired_ratio(spark, d):
    out = harness.paired_ratio(_t(spark, d, "orders"), ["o_orderpriority"], "o_orderstatus", "F", "O", "o_totalprice")
    return out.select("o_orderpriority", F.round("ratio", 8).alias("ratio"))


def relative_columns(spark, d):
    rows = _t(spark, d, "lineitem").groupBy("l_returnflag").agg(*(F.sum(c).alias(c) for c in COLS))
    return harness.relative_columns(rows, "l_extendedprice", COLS[:1]).select("l_returnflag", "l_quantity_rel")


def sorted_distinct(spark, d):
    return harness.sorted_distinct(_t(spark, d, "orders"), "o_orderpriority")


def config_grid(spark, d):
    return harness.config_grid(_t(spark, d, "region").select("r_name"), _t(spark, d, "nation").select("n_name"))


def repeated_corpus(spark, d):
    rows = harness.repeated(_t(spark, d, "benchmark"), 4)
    return rows.select("item_id", "copy", F.length("text").alias("n"))


def stacked_sum(spark, d):
    rows = _t(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return harness.stacked(rows, ["p_partkey"], ["p_size", "p_retailprice"]).select("p_partkey", "stage", "value", F.round("top", 4).alias("top"))


def reindexed_labels(spark, d):
    means = _t(spark, d, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return harness.reindexed(means, _t(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey")), "s_nationkey")


def filter_any(spark, d):
    rows = _t(spark, d, "orders")
    return harness.any_of(rows, F.col("o_orderstatus") == "P", F.col("o_totalprice") > 400000).select("o_orderkey", "o_orderstatus")


def head_rows(spark, d):
    return harness.head(_t(spark, d, "orders").select("o_orderkey", "o_custkey"), 10, "o_orderkey")


FOUND = (
    minmax_fit, minmax_fit_transform, minmax_transform_new_data, minmax_constant_column, minmax_nan, minmax_range_clip, minmax_inverse,
    minmax_merge_stats, minmax_array_fit, minmax_array_fit_transform, tokenize, cv_fit, cv_fit_transform, cv_transform_unseen,
    cv_stop_words, cv_token_pattern, cv_document_frequency, cv_binary, cv_bigrams, cv_csr_rows, cv_indptr, vocab_difference,
    sparse_unequal, label_mean, paired_ratio, relative_columns, sorted_distinct, config_grid, repeated_corpus, stacked_sum,
    reindexed_labels, filter_any, head_rows, minmax_empty, minmax_constant_other_value, minmax_dealt, cv_indptr_of_triplets, cv_inverse,
    cv_max_df_one, cv_min_df_all, cv_fixed_vocabulary, cv_char_grams, cv_case_kept, log_records, log_after_marker, first_fields,
    csv_round_trip, overhead_columns, lookup_default, affix_columns, close_pairs,
)


def queries() -> dict:
    return {f.__name__: f for f in FOUND}


# --- SQL ---------------------------------------------------------------------------------


def _scaled(value: str, low: str, high: str) -> str:
    inverse = f"(CASE WHEN {high} - {low} = 0::FLOAT THEN 0::FLOAT ELSE (1.0::DOUBLE / ({high} - {low})::DOUBLE)::FLOAT END)"
    return f"(({value})::FLOAT - {low}) * {inverse}"


def _fit_sql(table: str, cols: list[str], where: str = "true") -> str:
    parts = ", ".join(f"min({c}::FLOAT) lo_{c}, max({c}::FLOAT) hi_{c}" for c in cols)
    return f"SELECT {parts} FROM {table} WHERE {where}"


def _transform_sql(keys: str, table: str, cols: list[str], where: str = "true") -> str:
    out = ", ".join(f"{_scaled(c, f'lo_{c}', f'hi_{c}')} AS {c}" for c in cols)
    return f"WITH s AS ({_fit_sql(table, cols, where)}) SELECT {keys}, {out} FROM {table}, s"


def _tokens_sql(table: str, key: str, where: str = "true", pattern: str = RUNS, keep: str = "true") -> str:
    return (
        f"SELECT {key}, lower(w) AS token FROM (SELECT {key}, unnest(regexp_extract_all(text, '{pattern}')) AS w "
        f"FROM {table} WHERE {where}) x WHERE {keep}"
    )


def _cv_sql(table: str, key: str, **options) -> str:
    """CTEs t (tokens), v (vocabulary), c (counts)."""
    return (
        f"WITH t AS ({_tokens_sql(table, key, **options)}), "
        "v AS (SELECT token, (row_number() OVER (ORDER BY token) - 1)::INTEGER AS idx FROM (SELECT DISTINCT token FROM t) q), "
        f"c AS (SELECT {key}, token, count(*)::INTEGER AS count FROM t GROUP BY ALL)"
    )


def oracle_sql() -> dict[str, str]:
    keys = "l_orderkey, l_linenumber"
    docs = _cv_sql("documents", "doc_id")
    triplets = "SELECT doc_id, idx, count FROM c JOIN v USING (token)"
    unpivot = " UNION ALL ".join(f"SELECT '{c}' AS feature, lo_{c}::DOUBLE AS data_min, hi_{c}::DOUBLE AS data_max FROM s" for c in COLS)
    array_fit = (
        "SELECT pos, min(v) lo, max(v) hi FROM (SELECT unnest(range(len(embedding)))::INTEGER AS pos, unnest(embedding) AS v FROM embeddings) e "
        "GROUP BY pos"
    )
    bigram = (
        "w AS (SELECT item_id, list_transform(regexp_extract_all(text, '" + RUNS + "'), lambda x: lower(x)) AS l FROM benchmark), "
        "g AS (SELECT unnest(l) AS token FROM w UNION SELECT l[i] || ' ' || l[i + 1] FROM (SELECT l, unnest(range(1, len(l))) AS i FROM w) q)"
    )
    log = (
        "WITH g AS (SELECT o_orderpriority AS p, lower(o_orderstatus) AS s, count(*)::DOUBLE AS n, min(min(o_custkey)) OVER (PARTITION BY o_orderpriority) AS c "
        "FROM orders GROUP BY o_orderpriority, o_orderstatus)"
    )
    pivoted = ", ".join(f"max(n) FILTER (WHERE s = '{s}') AS fit_{s}" for s in "fop")
    return {
        "minmax_fit": f"WITH s AS ({_fit_sql('lineitem', COLS)}) {unpivot}",
        "minmax_fit_transform": _transform_sql(keys, "lineitem", COLS),
        "minmax_transform_new_data": _transform_sql(keys, "lineitem", COLS, "l_returnflag = 'A' AND l_quantity < 30"),
        "minmax_constant_column": _transform_sql("l_orderkey, 0::FLOAT AS constant", "lineitem", ["l_tax"]),
        "minmax_nan": (
            "WITH e AS (SELECT event_id, CASE WHEN event_id % 7 <> 0 AND event_id % 11 <> 0 THEN value END AS value FROM events), "
            "s AS (SELECT min(value::FLOAT) lo, max(value::FLOAT) hi FROM e) SELECT event_id, "
            f"CASE WHEN event_id % 11 = 0 THEN 'null' WHEN event_id % 7 = 0 THEN 'nan' ELSE 'number' END AS kind, {_scaled('value', 'lo', 'hi')} AS value FROM e, s"
        ),
        "minmax_range_clip": (
            f"WITH s AS ({_fit_sql('lineitem', ['l_quantity'], 'l_quantity < 30 AND l_linenumber <> 3')}) SELECT {keys}, "
            f"CASE WHEN l_linenumber <> 3 THEN greatest(least({_scaled('l_quantity', 'lo_l_quantity', 'hi_l_quantity')} * 2::FLOAT + (-1)::FLOAT, 1::FLOAT), (-1)::FLOAT) END AS l_quantity FROM lineitem, s"
        ),
        "minmax_inverse": (
            "WITH s AS (SELECT min(p_retailprice::FLOAT) lo, max(p_retailprice::FLOAT) hi FROM part) "
            f"SELECT {keys}, ((l_discount::FLOAT - 0::FLOAT) * 1::FLOAT) * (hi - lo) + lo AS l_discount FROM lineitem, s"
        ),
        "minmax_empty": (
            "SELECT f AS feature, 'Infinity' AS data_min, '-Infinity' AS data_max FROM (VALUES ('value'), ('nan'), ('null')) v(f)"
        ),
        "minmax_constant_other_value": f"SELECT {keys}, 0::FLOAT AS l_quantity FROM lineitem",
        "minmax_dealt": f"WITH s AS ({_fit_sql('lineitem', COLS)}) {unpivot}",
        "minmax_merge_stats": "SELECT 'o_totalprice' AS feature, min(o_totalprice::FLOAT)::DOUBLE AS data_min, max(o_totalprice::FLOAT)::DOUBLE AS data_max FROM orders",
        "minmax_array_fit": f"SELECT pos, lo::DOUBLE AS data_min, hi::DOUBLE AS data_max FROM ({array_fit}) a",
        "minmax_array_fit_transform": (
            f"WITH s AS ({array_fit}), e AS (SELECT vec_id, unnest(range(len(embedding)))::INTEGER AS pos, unnest(embedding) AS v FROM embeddings) "
            f"SELECT vec_id, pos, {_scaled('v', 'lo', 'hi')} AS scaled FROM e JOIN s USING (pos)"
        ),
        "tokenize": f"SELECT token, count(*) AS occurrences FROM ({_tokens_sql('documents', 'doc_id')}) t GROUP BY token",
        "cv_fit": f"{docs} SELECT token, idx FROM v",
        "cv_fit_transform": f"{docs} {triplets}",
        "cv_transform_unseen": (
            _cv_sql("documents", "doc_id", where="lang = 'en'")
            + f", u AS (SELECT row_id, lower(w) AS token FROM (SELECT conv_id * 1000 + turn AS row_id, unnest(regexp_extract_all(text, '{RUNS}')) AS w FROM conversations) x) "
            "SELECT row_id, idx, count(*)::INTEGER AS count FROM u JOIN v USING (token) GROUP BY ALL"
        ),
        "cv_stop_words": _cv_sql("documents", "doc_id", keep="lower(w) NOT IN ('the', 'de', 'la')") + " SELECT token, idx FROM v",
        "cv_token_pattern": _cv_sql("documents", "doc_id", pattern="[a-z]{4,}") + f" {triplets}",
        "cv_document_frequency": (
            f"{docs}, k AS (SELECT token, count(*) AS df, sum(count) AS total FROM c GROUP BY token), "
            "m AS (SELECT token FROM k WHERE df >= 3 AND df <= 0.5 * (SELECT count(*) FROM documents) ORDER BY total DESC, token LIMIT 500) "
            "SELECT token, (row_number() OVER (ORDER BY token) - 1)::INTEGER AS idx FROM m"
        ),
        "cv_binary": _cv_sql("benchmark", "item_id") + " SELECT item_id, idx, 1::INTEGER AS count FROM c JOIN v USING (token)",
        "cv_bigrams": f"WITH {bigram} SELECT token, (row_number() OVER (ORDER BY token) - 1)::INTEGER AS idx FROM (SELECT DISTINCT token FROM g) d",
        "cv_csr_rows": (
            f"{docs}, r AS (SELECT doc_id, string_agg(idx::VARCHAR, ',' ORDER BY idx) AS i, string_agg(count::VARCHAR, ',' ORDER BY idx) AS n "
            "FROM c JOIN v USING (token) GROUP BY doc_id) SELECT doc_id, coalesce(i, '') AS indices, coalesce(n, '') AS data FROM documents LEFT JOIN r USING (doc_id)"
        ),
        "cv_indptr": (
            f"{docs}, r AS (SELECT doc_id, count(*) AS k FROM c GROUP BY doc_id) SELECT doc_id, coalesce(k, 0)::BIGINT AS nnz, "
            "(sum(coalesce(k, 0)) OVER (ORDER BY doc_id))::BIGINT AS indptr FROM documents LEFT JOIN r USING (doc_id)"
        ),
        "vocab_difference": (
            f"WITH a AS (SELECT DISTINCT token FROM ({_tokens_sql('documents', 'doc_id', where=EN)}) t), "
            f"b AS (SELECT DISTINCT token FROM ({_tokens_sql('documents', 'doc_id', where=ES)}) t) "
            "SELECT token, 'left' AS side FROM (SELECT token FROM a EXCEPT SELECT token FROM b) x "
            "UNION ALL SELECT token, 'right' AS side FROM (SELECT token FROM b EXCEPT SELECT token FROM a) y"
        ),
        "sparse_unequal": (
            f"WITH t AS (SELECT * FROM (SELECT conv_id, role, lower(unnest(regexp_extract_all(text, '{RUNS}'))) AS token FROM conversations) x), "
            "c AS (SELECT conv_id, token, count(*) FILTER (WHERE role = 'user') AS u, count(*) FILTER (WHERE role = 'assistant') AS a FROM t GROUP BY ALL) "
            "SELECT count(*) AS n FROM c WHERE u <> a"
        ),
        "cv_indptr_of_triplets": (
            _cv_sql("documents", "doc_id", where="lang = 'en'")
            + f", u AS (SELECT DISTINCT item_id, token FROM ({_tokens_sql('benchmark', 'item_id')}) x JOIN v USING (token)), "
            "r AS (SELECT item_id, count(*) AS k FROM u GROUP BY item_id) SELECT item_id, coalesce(k, 0)::BIGINT AS nnz, "
            "(sum(coalesce(k, 0)) OVER (ORDER BY item_id))::BIGINT AS indptr FROM benchmark LEFT JOIN r USING (item_id)"
        ),
        "cv_inverse": _cv_sql("benchmark", "item_id") + " SELECT item_id, string_agg(token, ' ' ORDER BY token) AS tokens FROM c GROUP BY item_id",
        "cv_max_df_one": (
            _cv_sql("benchmark", "item_id") + ", m AS (SELECT token FROM c GROUP BY token HAVING count(*) <= 1) "
            "SELECT token, (row_number() OVER (ORDER BY token) - 1)::INTEGER AS idx FROM m"
        ),
        "cv_min_df_all": (
            _cv_sql("documents", "doc_id", where="lang = 'en' AND n_chars > 6000") + ", m AS (SELECT token FROM c GROUP BY token "
            "HAVING count(*) >= (SELECT count(*) FROM documents WHERE lang = 'en' AND n_chars > 6000)) SELECT token, (row_number() OVER (ORDER BY token) - 1)::INTEGER AS idx FROM m"
        ),
        "cv_fixed_vocabulary": (
            _cv_sql("benchmark", "item_id") + " SELECT item_id, k AS idx, count FROM c JOIN (VALUES ('the', 0), ('of', 1), ('no such', 2)) f(token, k) USING (token)"
        ),
        "cv_char_grams": (
            "WITH n AS (SELECT item_id, regexp_replace(lower(text), '\\s\\s+', ' ', 'g') AS s FROM benchmark), "
            "t AS (SELECT item_id, s[i:i + 2] AS token FROM (SELECT item_id, s, unnest(range(1, len(s) - 1)) AS i FROM n) q), "
            "v AS (SELECT token, (row_number() OVER (ORDER BY token) - 1)::INTEGER AS idx FROM (SELECT DISTINCT token FROM t) q) "
            "SELECT item_id, idx, count(*)::INTEGER AS count FROM t JOIN v USING (token) GROUP BY ALL"
        ),
        "cv_case_kept": (
            f"WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{RUNS}')) AS token FROM benchmark) "
            "SELECT token, (row_number() OVER (ORDER BY token) - 1)::INTEGER AS idx FROM t"
        ),
        "log_records": (
            f"{log} SELECT row_number() OVER (ORDER BY p) AS record, min(c)::DOUBLE AS n_unique_words, p[1]::DOUBLE AS dataset_length, {pivoted} FROM g GROUP BY p"
        ),
        # the first marker counts, later ones spoil their settings lines: one record is open, and the last of equal keys counts
        "log_after_marker": f"{log} SELECT {pivoted} FROM g WHERE p = (SELECT max(p) FROM g) GROUP BY p",
        "first_fields": "SELECT n_name AS text FROM nation",
        "csv_round_trip": "SELECT s_suppkey, s_name, s_acctbal FROM supplier",
        "overhead_columns": (
            "WITH t AS (SELECT l_returnflag, sum(l_quantity) AS total, sum(l_linenumber)::DOUBLE AS k FROM lineitem GROUP BY 1) SELECT l_returnflag, "
            "3 * k AS outer_overhead, round(2 * k / (total + 3 * k), 3) AS call_overhead, round(3 * k / (total + 3 * k), 3) AS outer_overhead_share FROM t"
        ),
        "lookup_default": (
            "SELECT n_nationkey AS s_nationkey, m IS NULL AS absent, m AS s_acctbal FROM nation LEFT JOIN "
            "(SELECT s_nationkey, min(s_acctbal) AS m FROM supplier WHERE s_acctbal > 2000 GROUP BY 1) s ON n_nationkey = s_nationkey"
        ),
        "affix_columns": "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders",
        "close_pairs": "SELECT p_partkey, p_partkey % 3 = 0 AS same FROM part",
        "label_mean": "SELECT CASE event_type WHEN 'click' THEN 'c' WHEN 'view' THEN 'v' ELSE 'other' END AS label, round(avg(value), 6) AS value FROM events GROUP BY 1",
        "paired_ratio": (
            "SELECT o_orderpriority, round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F') / avg(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 8) AS ratio "
            "FROM orders GROUP BY o_orderpriority"
        ),
        "relative_columns": "SELECT l_returnflag, round(sum(l_quantity) / sum(l_extendedprice), 3) AS l_quantity_rel FROM lineitem GROUP BY 1",
        "sorted_distinct": "SELECT DISTINCT o_orderpriority FROM orders",
        "config_grid": "SELECT r_name, n_name FROM region, nation",
        "repeated_corpus": "SELECT item_id, copy::INTEGER AS copy, length(text)::INTEGER AS n FROM benchmark, range(4) r(copy)",
        "stacked_sum": (
            "SELECT p_partkey, 'p_size' AS stage, p_size::DOUBLE AS value, round(p_size::DOUBLE, 4) AS top FROM part "
            "UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice, round(p_size + p_retailprice, 4) FROM part"
        ),
        "reindexed_labels": "SELECT n_nationkey AS s_nationkey, n FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) s ON n_nationkey = s_nationkey",
        "filter_any": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'P' OR o_totalprice > 400000",
        "head_rows": "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 10",
    }
