import pytest

LOREM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def words(seed: int, n: int) -> list[str]:
    """n words, determined by seed, hardly shared between seeds."""
    return [f"{LOREM[(seed * 7 + k * k + k) % 24]}{(seed * 1009 + k * 31) % 997}" for k in range(n)]


SHARED = words(99, 60)
TEXTS = {
    1: " ".join(words(1, 80)),
    2: " ".join(words(1, 80)),  # an exact copy
    3: "\n".join([*words(1, 79), "changed"]),  # a near copy with other blanks
    4: " ".join(words(2, 30) + SHARED + words(3, 30)),
    5: " ".join(SHARED[:50] + words(4, 200)),
    6: "",
    7: None,
    8: "Two words",
    9: "two WORDS",
    10: "again " * 400,
    11: " ".join(words(5, 20_000)),  # very long
    12: "again " * 300,
    13: " ".join(words(6, 13)),
    14: " ".join(words(6, 12)),
}


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with nulls, copies, empty and very long texts, a repeated row, a null id, and
    extra columns whose names operators use themselves."""
    rows = [(i, t, "en", None, 0, "x", 1, True) for i, t in TEXTS.items()] + [(8, "Two words", "en", None, 0, "x", 1, True), (None, "two words", None, None, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, node string, n_removed long, rejected boolean"
    return spark.createDataFrame(rows, schema).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0).cache()
