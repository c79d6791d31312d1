"""Scratch folders: owned by runs, removed after their last reader, also by an error."""

import glob
import warnings

import pytest
from pyspark.sql import functions as F

from bayeslake import fit, predict, standardize
from bayeslake.plans import catalog
from bayeslake.session import ensure_checkpoint_dir, kept, remove_scratch, scratch_path, scratch_run
from bayeslake.sources.tables import encode_codes

SF = "/root/testdata/sf0.001"


def folders(spark):
    return set(glob.glob(ensure_checkpoint_dir(spark).removeprefix("file:") + "/*"))


def test_fit_leaves_its_parameters_only(spark, h1):
    before = folders(spark)
    m = fit(h1, [("d", "label"), ("c", "label")])
    assert len(folders(spark) - before) == 1
    assert m.cpt.count() and predict(m, h1, "label").count() == h1.count()
    m.release()
    assert folders(spark) == before
    m.release()   # nothing left to remove


def test_wide_fit_leaves_its_parameters_only(spark):
    before = folders(spark)
    wide = spark.range(50).select((F.col("id") % 3).cast("int").alias("k"),
                                  *[(F.sin(F.col("id") * (j + 1))).alias(f"x{j}") for j in range(40)])
    m = fit(wide, [(f"x{j}", "k") for j in range(40)])
    assert len(folders(spark) - before) == 1
    m.release()
    with scratch_run(spark):
        assert standardize(wide).count() == 50
    assert folders(spark) == before


def test_models_in_use_survive_other_runs(spark, h1):
    m = fit(h1, [("d", "label"), ("c", "label")])
    want = sorted(map(tuple, predict(m, h1, "label").collect()))
    before = folders(spark)
    with scratch_run(spark):
        other = fit(h1, [("d", "label")])
        assert other.cpt.count()
        with scratch_run(spark) as inner:
            out = inner.result(predict(m, h1, "label"))
            kept(h1).count()
        assert sorted(map(tuple, out.collect())) == want
    assert folders(spark) == before           # the other model and ``out`` belonged to the run
    assert sorted(map(tuple, predict(m, h1, "label").collect())) == want
    m.release()


def test_a_saved_model_outlives_its_scratch(spark, h1, tmp_path):
    from bayeslake.operators.fit import Model
    m = fit(h1, [("d", "label"), ("c", "label")])
    m.save(str(tmp_path / "m"))
    want = sorted(map(tuple, predict(m, h1, "label").collect()))
    m.release()
    again = Model.load(spark, str(tmp_path / "m"))
    again.release()
    assert sorted(map(tuple, predict(again, h1, "label").collect())) == want


def test_an_error_leaves_nothing(spark, h1):
    before = folders(spark)
    with pytest.raises(ValueError, match="own error"):
        with scratch_run(spark):
            kept(h1)
            h1.write.parquet(scratch_path(spark, "t"))
            raise ValueError("own error")
    with pytest.raises(Exception):
        fit(h1.withColumn("c", F.raise_error(F.lit("broken row")).cast("double")), [("c", "label")])
    assert folders(spark) == before


def test_a_folder_that_cannot_be_removed_is_reported(spark):
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        remove_scratch(spark, ["nofilesystem://x/y"])
    assert any("was not removed" in str(w.message) for w in seen)


def test_codes_and_harness_leave_their_results_only(spark):
    before = folders(spark)
    with scratch_run(spark):
        assert encode_codes(catalog.read_table(spark, SF, "nation"), ["n_name"]).count() == 25
        assert catalog.worksheet_evaluate(spark, SF).count() > 0
    assert folders(spark) == before
    out = catalog.worksheet_evaluate(spark, SF)   # lazy: its table must outlive the run
    assert out.count() > 0
