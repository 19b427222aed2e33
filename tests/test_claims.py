"""Claims over run documents of any schema."""

from pyspark.sql import functions as F

from lotwise.operators import reporting
from lotwise.sources import runs


def claim(label, source, paths, form="%.3f", factor=1.0, records=None, where=None, how=None):
    return label, source, paths, form, factor, records, where, how


def test_claims_of_runs_of_different_schemas(spark, tmp_path):
    one = spark.range(1)
    runs.save_run(one, F.struct(F.struct(F.lit(0.7594).alias("mean"), F.lit(0.7).alias("lo")).alias("auc"), F.lit(1234).alias("n")), str(tmp_path / "r"), "eval")
    rows = F.array(*[F.struct(F.lit(v).alias("v"), F.lit(k).alias("fired")) for v, k in ((0.25, True), (0.5, False), (0.75, True))])
    runs.save_run(one, F.struct(rows.alias("records"), F.lit("text").alias("n")), str(tmp_path / "r"), "null")
    (tmp_path / "r" / "broken.json").write_text("{not json")
    (tmp_path / "r" / "plain.json").write_text('{"deep": [{"x": -0.25}]}')
    (tmp_path / "r" / "notes.txt").write_text("{}")
    found = runs.load_runs(spark, str(tmp_path / "r"))
    assert {r.source for r in found.collect()} == {"eval", "null", "broken", "plain"}
    claims = [
        claim("interval", "eval", ["$.auc.mean", "$.auc.lo"], "%.3f [%.3f]"), claim("thousands", "eval", ["$.n"], "%,.0f"), claim("percent", "eval", ["$.auc.lo"], "%.1f%%", 100.0),
        claim("deep", "plain", ["$.deep[0].x"], "%+.2f"), claim("fired", "null", ["$.v"], "%.0f", records="$.records", where="$.fired", how="count"),
        claim("most", "null", ["$.v", "$.v"], "%.2f/%.2f", records="$.records", where="$.fired", how="max"), claim("mean of all", "null", ["$.v"], "%.2f", records="$.records", how="avg"),
        claim("not a number", "null", ["$.n"]), claim("no such field", "eval", ["$.auc.mean", "$.auc.hi"], "%.3f %.3f"), claim("broken", "broken", ["$.n"]), claim("no run", "missing", ["$.n"]),
        claim("no records", "eval", ["$.v"], records="$.records", how="count"),
    ]
    texts = reporting.texts_of_claims(spark.createDataFrame(claims, reporting.CLAIM), found)
    got = {r.label: (r.text, r.status) for r in reporting.audited(texts, "0.759 [0.700] and 1,234, 70.0%, −0.25, 2 of 3, 0.75/0.75").collect()}
    assert got == {
        "interval": ("0.759 [0.700]", "ok"), "thousands": ("1,234", "ok"), "percent": ("70.0%", "ok"), "deep": ("-0.25", "ok"), "fired": ("2", "ok"), "most": ("0.75/0.75", "ok"),
        "mean of all": ("0.50", "absent"), "not a number": (None, "no value"), "no such field": (None, "no value"), "broken": (None, "no value"), "no run": (None, "no run"), "no records": (None, "no value"),
    }


def test_no_runs_at_all(spark, tmp_path):
    texts = reporting.texts_of_claims(spark.createDataFrame([claim("x", "eval", ["$.n"])], reporting.CLAIM), runs.load_runs(spark, str(tmp_path / "none")))
    assert [r.status for r in reporting.audited(texts, "").collect()] == ["no run"]
