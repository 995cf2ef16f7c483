"""The bootstrap driver goes on where it was stopped."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from lociforge.operators import study as S


@pytest.fixture(scope="module")
def samples(spark):
    x = np.random.default_rng(3).random((300, 3))
    return spark.createDataFrame([(k, int(v[0] + 0.2 * v[1] > 0.6), Vectors.dense(v)) for k, v in enumerate(x)], ["sample_id", "label", "features"]).cache()


def counted(monkeypatch, fail_at=None):
    made, real = [], S.evaluate

    def evaluate(train, test, name, holdouts=None, columns=None):
        made.append(name)
        if fail_at is not None and len(made) == fail_at:
            raise RuntimeError("the driver was killed")
        return real(train, test, name, holdouts, columns)

    monkeypatch.setattr(S, "evaluate", evaluate)
    return made


def test_a_second_run_makes_only_the_rest(spark, samples, tmp_path, monkeypatch):
    path, names = str(tmp_path / "study"), ["elastic_net", "naive_bayes"]
    counted(monkeypatch, fail_at=4)
    with pytest.raises(RuntimeError):
        S.bootstrap_models(samples, names, 3, 80, path=path, parallel=1)
    done = {(r.iteration, r.model_name) for r in S.finished_fits(spark, path).collect()}
    assert done == {(0, "elastic_net"), (0, "naive_bayes"), (1, "elastic_net")}
    monkeypatch.undo()
    # what a killed fit left half-written is neither read nor in the way
    spark.createDataFrame([("junk",)], "dataset string").write.parquet(f"{path}/metrics/iteration=2/model_name=naive_bayes")
    made = counted(monkeypatch)
    got = S.bootstrap_models(samples, names, 3, 80, path=path, parallel=2)
    assert sorted(made) == ["elastic_net", "naive_bayes", "naive_bayes"]
    again = counted(monkeypatch)
    assert S.bootstrap_models(samples, names, 3, 80, path=path).count() == got.count() == 12 and not again
    monkeypatch.undo()
    whole = S.bootstrap_models(samples, names, 3, 80, parallel=3)
    key = lambda df: sorted(str(sorted(r.asDict().items())) for r in df.collect())
    assert key(got) == key(whole)


def test_training_rows_are_let_go(spark, samples):
    before = len(spark.sparkContext._jsc.getPersistentRDDs())
    assert S.bootstrap_models(samples, ["elastic_net"], 2, 40, first=1).count() == 2
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == before
    with pytest.raises(ValueError):
        S.bootstrap_models(samples, [], 2, 40)
