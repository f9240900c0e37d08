import math

from pyspark.sql import functions as F

from proselens.operators import evaluate as E


def preds(spark, rows):
    return spark.createDataFrame(rows, "label int, prediction int, p double")


def test_macro_and_binary_f1(spark):
    rows = [(1, 1, .9)] * 6 + [(1, 0, .2)] * 2 + [(0, 1, .7)] * 1 + [(0, 0, .1)] * 3
    df = preds(spark, rows)
    f1_1 = 2 * 6 / (8 + 7)
    f1_0 = 2 * 3 / (4 + 5)
    assert abs(E.macro_f1(df).first()["macro_f1"] - (f1_0 + f1_1) / 2) < 1e-12
    assert abs(E.binary_f1(df).first()["f1"] - f1_1) < 1e-12
    assert abs(E.accuracy(df).first()["accuracy"] - 9 / 12) < 1e-12
    # class swap symmetry of macro-F1
    sw = df.select((1 - F.col("label")).alias("label"), (1 - F.col("prediction")).alias("prediction"))
    assert abs(E.macro_f1(sw).first()["macro_f1"] - (f1_0 + f1_1) / 2) < 1e-12


def test_f1_class_missing_from_predictions(spark):
    df = preds(spark, [(1, 1, .9), (0, 1, .8)])
    assert abs(E.macro_f1(df).first()["macro_f1"] - (2 / 3 + 0) / 2) < 1e-12


def test_log_loss_clipping(spark):
    df = preds(spark, [(1, 1, 1.0), (0, 0, 0.0), (1, 0, 0.5)])
    exp = (-math.log(1 - 1e-7) * 2 - math.log(0.5)) / 3
    assert abs(E.log_loss(df).first()["log_loss"] - exp) < 1e-12


def test_threshold_is_strict(spark):
    df = spark.createDataFrame([(0.5,), (0.5000001,)], "p double")
    assert [r[0] for r in df.select(E.threshold_label(F.col("p"))).collect()] == [0, 1]


def test_minmax_constant_column_and_train_fit(spark):
    df = spark.createDataFrame([(0, [1.0, 5.0], True), (1, [3.0, 5.0], True), (2, [5.0, 7.0], False)],
                               "id int, x array<double>, tr boolean")
    out = {r["id"]: r["x"] for r in E.minmax_scale(df, "x", F.col("tr")).collect()}
    assert out[0] == [0.0, 0.0] and out[1] == [1.0, 0.0]
    assert out[2] == [2.0, 2.0]  # not clipped; constant column -> x - min


def test_zscore_zero_variance(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 2.0])], "id int, x array<double>")
    out = {r["id"]: r["x"] for r in E.zscore_scale(df, "x").collect()}
    assert out[0] == [-1.0, 0.0] and out[1] == [1.0, 0.0]


def test_argmax_first_wins(spark):
    df = spark.createDataFrame([([0.1, 0.9, 0.9],), ([2.0, 1.0],)], "l array<double>")
    assert [r[0] for r in df.select(E.argmax_label(F.col("l"))).collect()] == [1, 0]


def test_folds_disjoint_and_complete(spark):
    df = spark.range(1000).selectExpr("id as doc_id", "1 as label")
    f = E.stratified_fold(df, 5)
    counts = {r["fold"]: r["count"] for r in f.groupBy("fold").count().collect()}
    assert set(counts) == set(range(5)) and sum(counts.values()) == 1000
    assert min(counts.values()) == 200


def test_best_candidate_tie_first(spark):
    m = spark.createDataFrame([(0, 0.5), (1, 0.7), (2, 0.7)], "candidate int, mean_score double")
    assert E.best_candidate(m).first()["candidate"] == 1


def test_early_stop(spark):
    losses = [1.0, 0.8, 0.7, 0.75, 0.76, 0.77, 0.78, 0.79, 0.5]  # stops before the late drop
    h = spark.createDataFrame([("r", i, v) for i, v in enumerate(losses)], "run string, epoch int, loss double")
    r = E.early_stop_epoch(h, patience=5).first()
    assert r["best_epoch"] == 2 and r["last_epoch"] == 7
