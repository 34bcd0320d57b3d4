"""Generated inputs: normal matrices and random sentences, partition by partition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"


def normal_matrix(spark: SparkSession, rows: int, cols: int, seed: int = 67, scale: float = 1.0, shift: float = 0.0) -> DataFrame:
    """(row_id, c0, c1, ...): float columns of scaled standard normals."""
    values = [(F.randn(seed + k) * scale + shift).cast("float").alias(f"c{k}") for k in range(cols)]
    return spark.range(rows).select(F.col("id").alias("row_id"), *values)


def random_corpus(spark: SparkSession, words: int, max_length: int, sentences: int, max_words: int, seed: int = 7) -> DataFrame:
    """(doc_id, text): sentences of 1 to max_words - 1 words out of ``words`` words, each of 2 to
    max_length - 1 letters, with a full stop.  Words are hashes of their number, so no table
    of words is kept."""
    def letters(word):
        size = 2 + F.pmod(F.xxhash64(word, F.lit(seed)), F.lit(max(max_length - 2, 1)))
        one = lambda k: F.substring(F.lit(LETTERS), (1 + F.pmod(F.xxhash64(word, k), F.lit(52))).cast("int"), F.lit(1))
        return F.array_join(F.transform(F.sequence(F.lit(1), size.cast("int")), one), "")

    count = 1 + F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(max(max_words - 1, 1)))
    chosen = F.transform(F.sequence(F.lit(1), count.cast("int")), lambda k: letters(F.pmod(F.xxhash64("id", k, F.lit(seed + 2)), F.lit(words))))
    return spark.range(sentences).select(F.col("id").alias("doc_id"), F.concat(F.array_join(chosen, " "), F.lit(".")).alias("text"))
