import pytest

from evimap.operators import learning


def test_self_training_separates_held_out_rows(spark):
    rows = [(i, float(i % 100), float(i * 7 % 13), i % 100 >= 85, i % 100 < 15) for i in range(1000)]
    df = spark.createDataFrame(rows, "protein long, a double, b double, high boolean, low boolean")
    out, model = learning.self_train(df, ("a", "b"), rounds=2, trees=5)
    got = out.collect()
    assert len(got) == 1000 and set(out.columns) == {*df.columns, "label", "probability", "positive"}
    assert all(r.label == (0.0 if r.low else 1.0) for r in got if r.high or r.low)
    far = [r for r in got if not 40 <= r.a < 60 and not (r.high or r.low)]
    assert sum(r.positive == (r.a > 50) for r in far) / len(far) > 0.75
    with pytest.raises(ValueError):
        learning.self_train(df.where("high"), ("a", "b"))


def test_modes_metrics_and_columns(spark, tmp_path):
    rows = [(i, float(i % 100), float(i * 7 % 13), i % 100 >= 85, i % 100 < 15) for i in range(400)]
    df = spark.createDataFrame(rows, "protein long, sequence_coverage double, b double, high boolean, low boolean")
    out, model, how = learning.classify(df, str(tmp_path / "none"), columns=("sequence_coverage", "b"), rounds=1, trees=3)
    assert how == "iterative-fallback"
    model.save(str(tmp_path / "model"))
    again, _, how = learning.classify(df, str(tmp_path / "model"))
    assert how == "pretrained" and [r.probability for r in again.orderBy("protein").collect()] == [r.probability for r in out.orderBy("protein").collect()]
    old, _, how = learning.classify(df.withColumnRenamed("sequence_coverage", "protein_coverage"), str(tmp_path / "model"))
    assert how == "pretrained" and set(old.columns) == {"protein", "protein_coverage", "b", "high", "low", "probability", "positive"}
    with pytest.raises(ValueError, match="b"):
        learning.pretrained(df.drop("b"), str(tmp_path / "model"))
    m = learning.metrics(out).first()
    assert m.accuracy > 0.9 and m.f1 > 0.9 and learning.area(out) > 0.9
    top = learning.importances(spark, model).first()
    assert top.feature == "sequence_coverage" and len(learning.COLUMNS) == 22


def test_default_search(spark):
    rows = [(i, float(i % 20), i % 20 >= 14, i % 20 < 6) for i in range(120)]
    df = spark.createDataFrame(rows, "protein long, a double, high boolean, low boolean")
    grid = learning.default_grid(learning.GBTClassifier())
    assert len(grid) == 20 and all(len(g) == 6 for g in grid)
    out, _ = learning.self_train(df, ("a",), rounds=1, grid=[{p: v for p, v in g.items() if p.name != "maxIter"} for g in grid[:2]], folds=2, trees=2)
    assert {r.positive for r in out.where("high or low").collect()} == {True, False}
