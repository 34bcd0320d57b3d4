from pyspark.sql import functions as F

from tessella.plans import harness
from tessella.sources import files, synthetic

LOG = """warm up
STARTANALYSIS
# note
{'Config': {'n_unique_words': 100}}
fit_map: 1.5 ms
fit_total: 3 ms
fit_map: 2.0 ms

{'Config': {'n_unique_words': 200}}
fit_total: 4 ms
"""


def test_log(spark, tmp_path):
    path = tmp_path / "log.txt"
    path.write_text(LOG)
    read = lambda: [tuple(r) for r in files.wide(files.read_log(spark, str(path)), ["fit_map", "fit_total"], ["n_unique_words"]).orderBy("record").collect()]
    assert read() == [(1, 100.0, 2.0, 3.0), (2, 200.0, None, 4.0)]
    path.write_text(LOG.replace("STARTANALYSIS\n", ""))  # without a marker the whole log counts
    assert read() == [(1, 100.0, 2.0, 3.0), (2, 200.0, None, 4.0)]
    path.write_text("{'Config': {'n_unique_words': 1}}\nfit_map: 9 ms\nSTARTANALYSIS {'Config': {'n_unique_words': 5, 'name': 'a,b'}}\nfit_total: 7 ms")
    assert read() == [(1, 5.0, None, 7.0)]
    assert files.read_log(spark, str(path)).first()["config"] == {"n_unique_words": "5", "name": "a,b"}


def test_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "n int, s string")
    files.write_csv(df, str(tmp_path / "t"))
    assert files.read_csv(spark, str(tmp_path / "t")).collect() == df.collect()
    (tmp_path / "l.txt").write_text("one,two\nthree\n")
    assert [r["text"] for r in files.read_first_field(spark, str(tmp_path / "l.txt")).collect()] == ["one", "three"]


def test_columns(spark):
    df = spark.createDataFrame([(1.0, 2.0, 4.0, 8.0)], "fit_map double, fit_sort double, fit_total double, python_total double")
    rel = harness.relative_columns(df, "fit_total", ["fit_map"]).first()
    assert rel["fit_map_rel"] == 0.25
    # a published row: total, call and outer time
    timed = spark.createDataFrame([(715.127, 550.208, 520.363)], "o double, i double, t double")
    over = harness.overhead_columns(timed, "o", "i", "t").first()
    assert (round(over["outer_overhead"], 3), over["call_overhead"], over["outer_overhead_share"]) == (194.764, 0.231, 0.272)
    assert harness.with_affixes(df, "fit_", without="total") == ["fit_map", "fit_sort"]
    assert [r["top"] for r in harness.stacked(df, [], ["fit_map", "fit_sort"]).collect()] == [1.0, 3.0]


def test_pairs(spark):
    df = spark.createDataFrame([("x", "base", 6.0), ("x", "new", 2.0), ("y", "base", 1.0)], "c string, version string, ms double")
    rows = {r["c"]: r["ratio"] for r in harness.paired_ratio(df, ["c"], "version", "base", "new", "ms").collect()}
    assert rows == {"x": 3.0, "y": None}
    keys = spark.createDataFrame([("x",), ("z",)], "c string")
    assert harness.lookup(df, keys, ["c"], "ms").filter(F.isnan("ms")).count() == 1
    assert harness.reindexed(df, keys, "c").filter("ms is null").count() == 1
    pairs = [(1.0, 1.0 + 1e-7, True), (1.0, 1.1, False), (float("nan"), float("nan"), True), (1.0, float("nan"), False), (float("nan"), 1.0, False)]
    assert [spark.range(1).select(harness.close(F.lit(a), F.lit(b)).alias("x")).first()["x"] for a, b, _ in pairs] == [x for _, _, x in pairs]
    many = spark.createDataFrame([("x", 3.0, 2), ("x", 5.0, 1)], "c string, ms double, at int")
    assert harness.lookup(many, keys, ["c"], "ms").filter("c = 'x'").first()["ms"] == 3.0
    assert harness.lookup(many, keys, ["c"], "ms", order="at").filter("c = 'x'").first()["ms"] == 5.0
    assert {r["c"]: r["ms"] for r in harness.group_mean(many, ["c"], ["ms"]).collect()} == {"x": 4.0}


def test_synthetic(spark):
    rows = synthetic.random_corpus(spark, 50, 6, 40, 8).collect()
    words = {w for r in rows for w in r["text"][:-1].split(" ")}
    assert all(r["text"].endswith(".") and 1 <= len(r["text"].split(" ")) <= 7 for r in rows)
    assert all(2 <= len(w) <= 5 for w in words) and len(words) <= 50
    moments = synthetic.normal_matrix(spark, 20_000, 1).agg(F.avg("c0"), F.stddev("c0")).first()
    assert abs(moments[0]) < 0.05 and abs(moments[1] - 1) < 0.05
