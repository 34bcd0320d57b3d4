"""Bag of words: vocabulary with lexicographic ids, and document-term counts as triplets.

Tokens are matched in the original text and lower-cased afterwards; stop words are compared
with the lower-cased token as they stand.  All is relational.  Texts are dealt over the cluster by
their id, once; from then on a document lies in one partition, so counting its tokens and gathering
its row need no further exchange, and of the tokens only distinct ones travel to become the
vocabulary.  Ids are ranks within blocks of tokens whose bounds come from a sample (they decide
how evenly work is dealt, never an id), and no vocabulary is sent to the driver.  Documents without
tokens have no triplets and an empty row in ``csr_rows``.
"""

from __future__ import annotations

import logging
import unicodedata
from collections.abc import Iterable, Mapping
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tessella.functions.patterns import DEFAULT_PATTERN, find_all, validate

LOG = logging.getLogger(__name__)
DEALT_BYTES = 8_000_000  # of input for a partition of texts
NARROW_BYTES = 16_000_000  # of input a core, under which texts are dealt even for a plain scan
SAMPLE_BYTES = 1_000_000  # of input from which the bounds of blocks are taken
BLOCKS = 256  # at most; a block's tokens are ranked in one task, which may spill


def stop_set(stop_words: str | Iterable[str] | None) -> list[str]:
    """None and "english" are empty, as in the reference; else the distinct words."""
    if stop_words is None or stop_words == "english":
        return []
    if isinstance(stop_words, str):
        raise ValueError(f"unknown stop words {stop_words!r}")
    return sorted(set(stop_words))


def _grams(words: Column, ngram_range: tuple[int, int]) -> Column:
    low, high = ngram_range
    if not 1 <= low <= high:
        raise ValueError("ngram_range must be 1 <= low <= high")
    if (low, high) == (1, 1):
        return words

    def runs(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.size(words) - n + 1)
        joined = F.transform(starts, lambda k: F.concat_ws(" ", F.slice(words, k, n)))
        return F.when(F.size(words) >= n, joined).otherwise(F.array().cast("array<string>"))

    each = [runs(n) for n in range(low, high + 1)]
    return F.concat(*each)


@lru_cache(maxsize=None)
def _accents() -> tuple[str, str]:
    """(letters with marks, the letters alone) of all code points that decompose into one letter."""
    pairs = []
    for code in range(0x80, 0x30000):
        bare = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(bare) == 1 and bare != chr(code) and not 0xD800 <= code < 0xE000:
            pairs.append((chr(code), bare))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def preprocess(text: Column, strip_accents: str | None = None) -> Column:
    """``text`` without accents: "unicode" replaces letters by their base and drops combining marks,
    "ascii" drops what is then not ASCII."""
    if strip_accents is None:
        return text
    if strip_accents not in ("unicode", "ascii"):
        raise ValueError(f"unknown strip_accents {strip_accents!r}")
    bare = F.regexp_replace(F.translate(text, *_accents()), r"\p{M}", "")
    return F.regexp_replace(bare, r"[^\x00-\x7F]", "") if strip_accents == "ascii" else bare


def _char_grams(text: Column, ngram_range: tuple[int, int]) -> Column:
    low, high = ngram_range
    if not 1 <= low <= high:
        raise ValueError("ngram_range must be 1 <= low <= high")
    whole = r"(?s)(?![\uDC00-\uDFFF])(?=(.{%d}))"  # never from the middle of a code point
    return F.concat(*(F.regexp_extract_all(text, F.lit(whole % n), F.lit(1)) for n in range(low, high + 1)))


def _padded_grams(text: Column, ngram_range: tuple[int, int]) -> Column:
    """n-grams of every word with a blank on either side; a shorter word is one of its own."""
    low, high = ngram_range
    each = []
    for n in range(low, high + 1):
        grams = lambda w, n=n: F.when(F.length(w) >= n, _char_grams(w, (n, n))).otherwise(
            F.array(w) if n == low else F.array().cast("array<string>")
        )
        each.append(F.flatten(F.transform(F.filter(F.split(text, r"\s+"), lambda w: w != ""), lambda w: grams(F.concat(F.lit(" "), w, F.lit(" "))))))
    return F.concat(*each)


def analyzed(
    text: Column, java: str, stop_words=None, ngram_range: tuple[int, int] = (1, 1), analyzer: str = "word", lowercase: bool = True,
    strip_accents: str | None = None,
) -> Column:
    """array<string>: the tokens of a text, in order."""
    text = preprocess(text, strip_accents)
    if analyzer in ("char", "char_wb"):
        flat = F.lower(text) if lowercase else text
        return _char_grams(F.regexp_replace(flat, r"\s\s+", " "), ngram_range) if analyzer == "char" else _padded_grams(flat, ngram_range)
    if analyzer != "word":
        raise ValueError(f"unknown analyzer {analyzer!r}")
    words = find_all(text, java)
    words = F.transform(words, F.lower) if lowercase else words
    stops = stop_set(stop_words)
    return _grams(F.filter(words, lambda w: ~w.isin(stops)) if stops else words, ngram_range)


def tokenize(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", token_pattern: str = DEFAULT_PATTERN, n_jobs: int | None = None, **options) -> DataFrame:
    """(id_col, token), one row per occurrence."""
    return _tokens(spread(df, id_col, text_col, n_jobs), id_col, text_col, token_pattern, **options)


def _tokens(df: DataFrame, id_col: str, text_col: str, token_pattern: str = DEFAULT_PATTERN, **options) -> DataFrame:
    java = validate(df.sparkSession, token_pattern)
    stops = stop_set(options.get("stop_words"))
    lowercase = options.get("lowercase", True)
    plain = options.get("ngram_range", (1, 1)) == (1, 1) and options.get("analyzer", "word") == "word"
    rows = df.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias("_text"))
    if not plain:
        return rows.select(id_col, F.explode(analyzed(F.col("_text"), java, **options)).alias("token"))
    # cases and stop words of single words are columns of the exploded rows, within generated code
    rows = rows.select(id_col, F.explode(find_all(preprocess(F.col("_text"), options.get("strip_accents")), java)).alias("token"))
    rows = rows.withColumn("token", F.lower("token")) if lowercase else rows
    rows = rows.filter("token is not null")  # never so, but joins add it: said once, plans of equal parts are equal
    return rows.filter(~F.col("token").isin(stops)) if stops else rows


def _bytes(df: DataFrame) -> int | None:
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 55 else None


def _parts(rows: DataFrame) -> int:
    """How many partitions texts are dealt into."""
    spark = rows.sparkSession
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return max(least, (_bytes(rows) or 0) // DEALT_BYTES)


def dealt(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_jobs: int | None = None) -> DataFrame:
    """(id_col, text_col) dealt over the cluster by id: texts move once, whatever the file's row
    groups are, and all that is grouped by document later stays where it is."""
    rows = df.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias(text_col))
    return rows.repartition(n_jobs or _parts(rows), F.col(f"`{id_col}`"))


def spread(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_jobs: int | None = None) -> DataFrame:
    """(id_col, text_col), dealt only if the input is narrow: a small file often is one row group, and
    so one busy task.  A large input has splits for all cores and is read as it lies."""
    rows = df.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias(text_col))
    size = _bytes(rows)
    narrow = size is not None and size < NARROW_BYTES * df.sparkSession.sparkContext.defaultParallelism
    return dealt(df, id_col, text_col, n_jobs) if narrow or n_jobs else rows


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_jobs: int | None = None, **options) -> DataFrame:
    """(id_col, token, count)."""
    tokens = _tokens(dealt(df, id_col, text_col, n_jobs), id_col, text_col, **options)
    return tokens.groupBy(id_col, "token").agg(F.count(F.lit(1)).cast("int").alias("count"))


def _bounds(values: list) -> list:
    """Values that cut the sorted sample into blocks of equal size."""
    values = sorted(set(values))
    n = min(BLOCKS, len(values))
    return [values[len(values) * k // n] for k in range(1, n)]


def _block(c: Column, bounds: list, first: int = 0) -> Column:
    """How many bounds are at most ``c``, by halving; null belongs to block 0."""
    if not bounds:
        return F.lit(first)
    half = len(bounds) // 2
    upper = _block(c, bounds[half + 1 :], first + half + 1)
    return F.when(c >= F.lit(bounds[half]), upper).otherwise(_block(c, bounds[:half], first))


def _firsts(blocks: DataFrame, total: Column) -> DataFrame:
    """(_b, _first): sum of ``total`` over the blocks before; at most BLOCKS rows."""
    before = F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    sums = blocks.groupBy("_b").agg(total.alias("_n"))
    return F.broadcast(sums.select(F.col("_b").alias("_block"), F.coalesce(before, F.lit(0)).alias("_first")))


def token_bounds(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> list[str]:
    """Bounds of token blocks from about SAMPLE_BYTES of the input."""
    size = _bytes(df.select(F.col(f"`{text_col}`"))) or SAMPLE_BYTES
    some = df.sample(SAMPLE_BYTES / size, seed=7) if size > SAMPLE_BYTES else df
    options.pop("n_jobs", None)
    tokens = _tokens(some, id_col, text_col, **options).select("token").distinct()
    return _bounds([r["token"] for r in tokens.orderBy(F.xxhash64("token")).limit(8 * BLOCKS).collect()])


def vocabulary_of(tokens: DataFrame, bounds: list[str], distinct: bool = False) -> DataFrame:
    """(token, idx): ids 0.. in byte order of the tokens, made distinct unless they are.

    A token's id is the number of tokens in earlier blocks plus its rank in its own: only the
    blocks' counts, not the vocabulary, pass through one task."""
    one = tokens.select("token") if distinct else tokens.select("token").distinct()
    ranked, firsts = _ranked(one.withColumn("_b", _block(F.col("token"), bounds)))
    return ranked.join(firsts, ranked["_b"] == firsts["_block"]).select("token", _id())


def _ranked(one: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct tokens with their rank ``_r`` in their block ``_b``, and the first id of each block."""
    rank = F.row_number().over(Window.partitionBy("_b").orderBy("token")) - 1
    return one.withColumn("_r", rank), _firsts(one, F.count(F.lit(1)))


def _id() -> Column:
    return (F.col("_first") + F.col("_r")).cast("int").alias("idx")


def _unlimited(min_df, max_df, max_features) -> bool:
    """Whether all tokens stay: 1 is a number of documents, 1.0 a share of them."""
    return isinstance(min_df, int) and min_df <= 1 and isinstance(max_df, float) and max_df == 1.0 and max_features is None


def _limit(counts: DataFrame, n_docs, min_df, max_df, max_features) -> DataFrame:
    """Tokens of ``counts`` that keep within document-frequency bounds and the size limit."""
    per = counts.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.sum("count").alias("total"))
    low = min_df * n_docs if isinstance(min_df, float) else min_df
    high = max_df * n_docs if isinstance(max_df, float) else max_df
    kept = per.filter((F.col("df") >= low) & (F.col("df") <= high))
    if max_features is not None:
        kept = kept.orderBy(F.desc("total"), "token").limit(max_features)
    return kept


def cv_fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_df=1, max_df=1.0, max_features: int | None = None, n_jobs=None, **options) -> DataFrame:
    """The vocabulary (token, idx)."""
    bounds = token_bounds(df, id_col, text_col, **options)
    if _unlimited(min_df, max_df, max_features):
        return vocabulary_of(tokenize(df, id_col, text_col, n_jobs=n_jobs, **options), bounds)
    counts = token_counts(df, id_col, text_col, n_jobs, **options)
    return vocabulary_of(_limit(counts, df.count(), min_df, max_df, max_features), bounds, distinct=True)


def _with_ids(counts: DataFrame, vocabulary: DataFrame, id_col: str, binary: bool) -> DataFrame:
    """No hint: a small vocabulary is broadcast by the planner or at run time, a large one is joined
    by token, where Spark splits the rows of a frequent token."""
    known = counts.join(vocabulary, "token").select(id_col, "idx", "count")
    return known.withColumn("count", F.lit(1).cast("int")) if binary else known


def cv_transform(df: DataFrame, vocabulary: DataFrame, id_col: str = "doc_id", binary: bool = False, **options) -> DataFrame:
    """(id_col, idx, count); tokens that the vocabulary lacks are left out."""
    return _with_ids(token_counts(df, id_col, **options), vocabulary, id_col, binary)


def _shard(id_col: str, n: int) -> Column:
    """The shard of a document, of ``n``; never null."""
    return F.coalesce(F.pmod(F.hash(F.col(f"`{id_col}`")), F.lit(n)), F.lit(0)).alias("_p")


def _cells(df: DataFrame, bounds: list[str], n: int, id_col: str, text_col: str, token_pattern: str = DEFAULT_PATTERN, n_jobs: int | None = None, **options) -> DataFrame:
    """(id_col, _p, idx, count), lying in ``n`` shards ``_p`` of documents.

    Texts are tokenised once, on their way into the shards.  Of a shard only its distinct tokens travel, to be ranked and
    back: a token is at most as many rows as there are shards, however many documents hold it.  Then occurrences meet the
    ids of their own shard without an exchange and are counted by number.  Joins of single words hash the distinct ones of a
    shard, or of its share of the blocks, and sort nothing; grams, and texts of unknown size, are left to joins that spill."""
    few = _bytes(df) is not None and options.get("ngram_range", (1, 1)) == (1, 1) and options.get("analyzer", "word") == "word"
    hashed = lambda x: x.hint("shuffle_hash") if few else x
    words = analyzed(F.col(f"`{text_col}`"), validate(df.sparkSession, token_pattern), **options)
    rows = spread(df, id_col, text_col, n_jobs).select(F.col(f"`{id_col}`").alias(id_col), _shard(id_col, n), words.alias("_w"))
    # an outer explode: for a plain one the optimizer adds a filter on sizes, which tokenises all texts once more
    tokens = rows.repartitionById(n, F.col("_p")).select(id_col, "_p", F.explode_outer("_w").alias("token")).filter("token is not null")
    # these filters change nothing: asking for all columns makes the readings of an exchange equal, so it is made once
    one = tokens.groupBy("_p", "token").agg(F.count(F.col(f"`{id_col}`")).alias("_s")).filter("_s >= 0").select("_p", "token")
    one = one.withColumn("_b", _block(F.col("token"), bounds)).repartitionById(n, F.col("_b"))
    each = one.groupBy("_b", "token").agg(F.min("_p").alias("_s")).filter("_s >= 0").select("_b", "token")
    ranked, firsts = _ranked(each)
    ranked = one.join(hashed(ranked.select(F.col("_b").alias("_c"), F.col("token").alias("_t"), "_r")), (F.col("_b") == F.col("_c")) & (F.col("token") == F.col("_t")))
    known = ranked.join(firsts, ranked["_b"] == firsts["_block"]).select(F.col("_p").alias("_q"), "_t", _id())
    found = tokens.join(hashed(known.repartitionById(n, F.col("_q"))), (F.col("_p") == F.col("_q")) & (F.col("token") == F.col("_t")))
    return found.groupBy(id_col, "_p", "idx").agg(F.count(F.lit(1)).cast("int").alias("count"))


def cv_fit_transform(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", binary: bool = False, min_df=1, max_df=1.0, max_features=None, **options) -> tuple[DataFrame, DataFrame]:
    """(vocabulary, triplets)."""
    bounds = token_bounds(df, id_col, text_col, **options)
    if _unlimited(min_df, max_df, max_features):
        triplets = _cells(df, bounds, options.get("n_jobs") or _parts(df), id_col, text_col, **options).select(id_col, "idx", "count")
        triplets = triplets.withColumn("count", F.lit(1).cast("int")) if binary else triplets
        return vocabulary_of(tokenize(df, id_col, text_col, **options), bounds), triplets
    counts = token_counts(df, id_col, text_col, **options)
    vocabulary = vocabulary_of(_limit(counts, df.count(), min_df, max_df, max_features), bounds, distinct=True)
    return vocabulary, _with_ids(counts, vocabulary, id_col, binary)


def csr_rows(df: DataFrame, triplets: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, indices, data): one compressed row per document of ``df``, empty ones too."""
    cells = triplets.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("idx", "count"))).alias("cells")).withColumnRenamed(id_col, "_k")
    rows = df.select(F.col(f"`{id_col}`").alias(id_col))
    # null-safe, then null ids left without cells: a filter on ids would part the readings of the texts, which are shared
    rows = rows.join(cells, F.col(f"`{id_col}`").eqNullSafe(F.col("_k")), "left")
    rows = rows.withColumn("cells", F.when(F.col(f"`{id_col}`").isNotNull(), F.col("cells")))
    none = F.array().cast("array<int>")
    return rows.select(
        id_col,
        F.coalesce(F.transform("cells", lambda c: c["idx"]), none).alias("indices"),
        F.coalesce(F.transform("cells", lambda c: c["count"]), none).alias("data"),
    )


def row_sizes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", token_pattern: str = DEFAULT_PATTERN, **options) -> DataFrame:
    """(id_col, nnz): how many cells the row of each document has under its own vocabulary: its
    distinct tokens, counted in place, without a vocabulary."""
    java = validate(df.sparkSession, token_pattern)
    tokens = analyzed(F.col(f"`{text_col}`"), java, **options)
    return dealt(df, id_col, text_col).select(id_col, F.coalesce(F.size(F.array_distinct(tokens)), F.lit(0)).cast("long").alias("nnz"))


def running_ends(sizes: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, nnz, indptr): end of each document's row, documents in order of id.

    Blocks of ids, with bounds from a sample of them, are summed apart; only the blocks' sums pass
    through one task.  Rows without an id come first."""
    key = F.col(f"`{id_col}`")
    some = sizes.select(key.alias("k")).filter("k is not null").orderBy(F.xxhash64("k")).limit(8 * BLOCKS)
    rows = sizes.withColumn("_b", _block(key, _bounds([r["k"] for r in some.collect()])))
    inside = F.sum("nnz").over(Window.partitionBy("_b").orderBy(id_col).rowsBetween(Window.unboundedPreceding, 0))
    ended, firsts = rows.withColumn("_i", inside), _firsts(rows, F.sum("nnz"))
    return ended.join(firsts, ended["_b"] == firsts["_block"]).select(id_col, "nnz", (F.col("_first") + F.col("_i")).alias("indptr"))


def indptr(df: DataFrame, triplets: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``running_ends`` of given triplets, over all documents of ``df``."""
    per = triplets.groupBy(id_col).agg(F.count(F.lit(1)).alias("nnz"))
    rows = df.select(F.col(f"`{id_col}`").alias(id_col)).join(per, id_col, "left").withColumn("nnz", F.coalesce("nnz", F.lit(0)))
    return running_ends(rows, id_col)


def inverse_transform(triplets: DataFrame, vocabulary: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, tokens): the distinct tokens of each document, in order of id."""
    named = triplets.join(vocabulary, "idx").groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("idx", "token"))).alias("t"))
    return named.select(id_col, F.transform("t", lambda t: t["token"]).alias("tokens"))


class CountVectorizer:
    """Estimator form.  A fitted ``vocabulary_`` is a DataFrame (token, idx).

    ``vocabulary`` fixes it: a DataFrame, a mapping of tokens to ids, or tokens, numbered in their
    order; fitting then changes nothing.  ``n_jobs`` is the number of partitions that texts are
    dealt into.  ``metrics`` has what Spark observed in the last fit, once a result was computed."""

    DEFAULTS = {
        "id_col": "doc_id", "text_col": "text", "token_pattern": DEFAULT_PATTERN, "stop_words": None, "vocabulary": None, "n_jobs": None,
        "ngram_range": (1, 1), "min_df": 1, "max_df": 1.0, "max_features": None, "binary": False, "analyzer": "word", "lowercase": True,
        "strip_accents": None, "encoding": "utf-8",
    }
    READING = ("id_col", "text_col", "token_pattern", "stop_words", "n_jobs", "ngram_range", "analyzer", "lowercase", "strip_accents")

    def __init__(self, **params):
        self.params: dict = dict(self.DEFAULTS)
        self.vocabulary_ = None
        self.observation_: Observation | None = None
        self.set_params(**params)

    def get_params(self, deep: bool = True) -> dict:
        return dict(self.params)

    def set_params(self, **params) -> CountVectorizer:
        unknown = set(params) - set(self.DEFAULTS)
        if unknown:
            raise ValueError(f"unknown parameters {sorted(unknown)}")
        if params.get("n_jobs") is not None and params["n_jobs"] < 1:
            raise ValueError("n_jobs must be at least 1")
        self.params |= params
        if isinstance(params.get("vocabulary"), DataFrame):
            self.vocabulary_ = params["vocabulary"]
        return self

    def _options(self, *names: str) -> dict:
        return {k: self.params[k] for k in (*self.READING, *names)}

    def _fixed(self, df: DataFrame) -> DataFrame | None:
        given = self.params["vocabulary"]
        if given is None or isinstance(given, DataFrame):
            return given
        pairs = list(given.items()) if isinstance(given, Mapping) else [(t, k) for k, t in enumerate(dict.fromkeys(given))]
        return df.sparkSession.createDataFrame(pairs, "token string, idx int")

    def _observed(self, df: DataFrame) -> DataFrame:
        self.observation_ = Observation()
        chars = F.sum(F.length(F.col(f"`{self.params['text_col']}`")))
        return df.observe(self.observation_, F.count(F.lit(1)).alias("documents"), chars.alias("characters"))

    @property
    def metrics(self) -> dict:
        """documents and characters of the last fit; waits until a result was computed."""
        return {} if self.observation_ is None else dict(self.observation_.get)

    def fit(self, df: DataFrame, y=None) -> CountVectorizer:
        self.vocabulary_ = self._fixed(df)
        if self.vocabulary_ is None:
            self.vocabulary_ = cv_fit(self._observed(df), **self._options("min_df", "max_df", "max_features"))
        LOG.debug("fit planned with %s", self.params)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        known = self.vocabulary_ if self.vocabulary_ is not None else self._fixed(df)
        if known is None:
            raise ValueError("not fitted")
        return cv_transform(df, known, **self._options("binary"))

    def fit_transform(self, df: DataFrame, y=None) -> DataFrame:
        if self.params["vocabulary"] is not None:
            return self.fit(df).transform(df)
        self.vocabulary_, triplets = cv_fit_transform(self._observed(df), **self._options("min_df", "max_df", "max_features", "binary"))
        return triplets

    def inverse_transform(self, triplets: DataFrame) -> DataFrame:
        return inverse_transform(triplets, self.vocabulary_, self.params["id_col"])

    def get_feature_names_out(self, input_features=None) -> DataFrame:
        return self.vocabulary_.orderBy("idx").select("token")

    def get_stop_words(self) -> list[str]:
        return stop_set(self.params["stop_words"])

    def decode(self, data: Column) -> Column:
        """Text of a binary column; text stays."""
        return F.decode(data, self.params["encoding"])

    def build_preprocessor(self):
        """Column to column: accents stripped as ``strip_accents`` says."""
        return lambda text: preprocess(text, self.params["strip_accents"])

    def build_tokenizer(self):
        """Column to array column: matches of the pattern in the original case."""
        from pyspark.sql import SparkSession

        java = validate(SparkSession.getActiveSession(), self.params["token_pattern"])
        return lambda text: find_all(text, java)

    def build_analyzer(self):
        """Column to array column: what is counted."""
        from pyspark.sql import SparkSession

        java = validate(SparkSession.getActiveSession(), self.params["token_pattern"])
        own = {k: self.params[k] for k in ("stop_words", "ngram_range", "analyzer", "lowercase", "strip_accents")}
        return lambda text: analyzed(text, java, **own)
