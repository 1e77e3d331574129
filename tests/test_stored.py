"""Stored models: checked when loaded, with the power curve where anything differs."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from gustline.functions import wind as W
from gustline.operators import stored
from gustline.operators.checks import ContractError


@pytest.fixture(scope="module")
def rows(spark):
    """Thirty days of three plants, and a fourth that comes after training; the curve misses 0.02 u."""
    out = spark.range(720).select(F.col("id").alias("hour")).withColumn("plant", F.explode(F.array(*map(F.lit, "abcd")))).where("plant <> 'd' OR hour >= 500")
    out = out.withColumns({"u": F.pmod(F.xxhash64("hour", "plant"), F.lit(5)).cast("double"), "w": F.lit(9.0), "cap": F.lit(100.0), "avail": F.lit(1.0)}).withColumn("base", W.power(F.col("w"), F.col("cap"), F.col("avail")))
    return out.withColumn("gen", F.col("base") + 2 * F.col("u")).withColumn("residual", (F.col("gen") - F.col("base")) / 100).cache()


@pytest.fixture(scope="module")
def kept(rows, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('kept')}/model"
    stored.save(rows.where("hour < 490"), rows.where("hour >= 500"), f"file://{path}", "plant", "hour", ["u"], "residual")
    return path


def copied(kept, tmp_path):
    return shutil.copytree(kept, tmp_path / "model")


def loaded(spark, path):
    return stored.load(spark, f"file://{path}")


def test_the_loaded_model_estimates_and_knows_its_groups(spark, rows, kept):
    model = loaded(spark, kept)
    assert model.fault is None and model.features == ("u",) and model.evaluation["rows"] == 880
    holes = rows.withColumn("u", F.when((F.col("hour") != 3) | (F.col("plant") != "a"), F.col("u")))
    out = model.estimate(holes, "plant").cache()
    assert {r["reason"]: r["count"] for r in out.groupBy("reason").count().collect()} == {"model": 2159, "unknown_group": 220, "incomplete": 1}
    assert out.where("reason = 'model'").agg(F.max(F.abs(F.col("hybrid") - F.col("gen")))).first()[0] < 0.05
    assert out.where("reason <> 'model' AND hybrid <> base").count() == 0


@pytest.mark.parametrize("part", ["model", "groups", "evaluation"])
def test_one_changed_byte_gives_the_curve(spark, rows, kept, tmp_path, part):
    path = copied(kept, tmp_path)
    name = next(n for n in sorted(os.listdir(path / part)) if n.endswith(".parquet"))
    body = bytearray((path / part / name).read_bytes())
    body[len(body) // 2] ^= 1
    (path / part / name).write_bytes(body)
    for crc in (path / part).glob(".*.crc"):
        crc.unlink()
    model = loaded(spark, path)
    assert model.fault == "changed"
    out = model.estimate(rows, "plant")
    assert out.where("hybrid = base AND reason = 'changed'").count() == rows.count()
    with pytest.raises(ContractError):
        stored.reevaluate(model, rows, "plant", "hour")


def test_added_and_missing_files(spark, kept, tmp_path):
    path = copied(kept, tmp_path)
    (path / "model" / "more.parquet").write_bytes(b"x")
    assert loaded(spark, path).fault == "changed"
    shutil.rmtree(path / "evaluation")
    assert loaded(spark, path).fault == "missing"
    assert loaded(spark, tmp_path / "nowhere").fault == "missing"


def sealed(spark, path, part, table):
    """A part replaced together with its hashes, as someone would who rewrites the manifest too."""
    out = f"{path}.{part}"
    table.coalesce(1).write.parquet(f"file://{out}")
    shutil.rmtree(path / part)
    shutil.move(out, path / part)
    shutil.rmtree(path / "manifest")
    stored.file_hashes(spark, f"file://{path}").coalesce(1).write.parquet(f"file://{path}/manifest")


def test_contradicting_approval_and_terms_that_are_no_numbers(spark, kept, tmp_path):
    path = copied(kept, tmp_path)
    facts = spark.read.parquet(f"file://{kept}/evaluation")
    sealed(spark, path, "evaluation", facts.withColumn("hybrid_mae", F.col("base_mae") + 1))
    assert loaded(spark, path).fault == "invalid"
    sealed(spark, path, "evaluation", facts.withColumn("hybrid_mae", F.col("base_mae") + 1).withColumn("approved", F.lit(False)))
    assert loaded(spark, path).fault == "not_approved"
    sealed(spark, path, "evaluation", facts)
    sealed(spark, path, "model", spark.read.parquet(f"file://{kept}/model").withColumn("coefficient", F.lit(float("nan"))))
    assert loaded(spark, path).fault == "invalid"


def test_judged_again_on_the_recorded_rows_only(spark, rows, kept):
    model = loaded(spark, kept)
    again = stored.reevaluate(model, rows.repartition(7), "plant", "hour").first()
    assert [again[c] for c in ("rows", "base_mae", "hybrid_mae")] == pytest.approx([model.evaluation[c] for c in ("rows", "base_mae", "hybrid_mae")], rel=1e-12)
    for other in (rows.where("hour <> 600 OR plant <> 'a'"), rows.withColumn("gen", F.when((F.col("hour") == 600) & (F.col("plant") == "a"), F.col("gen") + 0.001).otherwise(F.col("gen")))):
        with pytest.raises(ContractError):
            stored.reevaluate(model, other, "plant", "hour")


def test_what_can_not_be_kept(rows, kept, tmp_path):
    save = lambda training, test, path=f"file://{tmp_path}/m": stored.save(training, test, path, "plant", "hour", ["u"], "residual")
    for training, test in ((rows.where("false"), rows), (rows, rows.where("false")), (rows.where("hour < 500"), rows.where("hour >= 499")), (rows.where("hour < 490").withColumn("u", F.lit(None).cast("double")), rows.where("hour >= 500"))):
        with pytest.raises(ContractError):
            save(training, test)
    with pytest.raises(ContractError):
        save(rows.where("hour < 490"), rows.where("hour >= 500"), f"file://{kept}")
