"""Stages: outputs, resuming, digests against a snapshot, named choices."""

import pytest

from stylometra import __main__ as command
from stylometra import workflow

TABLES = "/root/testdata/sf0.001"


def test_run_resume_and_compare(spark, tmp_path, capsys):
    out = f"file://{tmp_path}/out"
    small = ["--set", "fit.draws=2", "--set", "fit.lams=10,1000", "--set", "redate.lams=10,1000", "--set", "redate.rates=0,1", "--set", "select.sizes=3", "--set", "matrix.klex=8"]
    assert command.main(["pipeline", "--tables", TABLES, "--out", out, *small]) == 0
    said = capsys.readouterr().out
    assert "[6/6] select" in said and "no snapshot" in said
    assert {r.rate for r in spark.read.parquet(f"{out}/redated").collect()} == {0.0, 1.0} and spark.read.parquet(f"{out}/metrics").count() == 3
    assert command.main(["pipeline", "--out", out, "--snapshot"]) == 0 and "13 outputs recorded" in capsys.readouterr().out
    # from the second stage to the third with another scale: what they write differs, the rest stays
    assert command.main(["pipeline", "--tables", TABLES, "--out", out, "--from", "2", "--to", "3", *small, "--set", "matrix.transform=log1p"]) == 0
    said = capsys.readouterr().out
    assert "[1/6] extract: skipped" in said and "matrix: changed" in said and "features: changed" in said and "counts: same" in said and "vocabulary: same" in said and "chunks: same" in said
    assert command.main(["pipeline", "--tables", TABLES, "--out", out, "--from", "2", "--to", "3", *small]) == 0
    assert "changed" not in capsys.readouterr().out


def test_choices_have_names(spark, capsys):
    assert command.main(["stages"]) == 0
    said = capsys.readouterr().out
    assert all(x in said for x in ("nested within strata", "log1p", "compressed", "draws=20"))
    for wrong in (["fit.model=other"], ["fit.nothing=1"], ["nothing.draws=1"]):
        assert command.main(["pipeline", "--tables", TABLES, "--out", "file:///tmp/none", "--set", *wrong]) == 2
    fit = next(s for s in workflow.STAGES if s.name == "fit")
    assert workflow.settings(fit, {"draws": "300", "lams": "1,10"}) == {**fit.parameters, "draws": 300, "lams": [1.0, 10.0]}


def test_digest_ignores_order_alone(spark):
    a = spark.createDataFrame([(1, "x", 0.1 + 0.2, [1.0]), (2, None, None, None)], "a int, b string, c double, d array<double>")
    b = spark.createDataFrame([(None, [1.0 + 1e-12], "x", 1), (None, None, None, 2)], "c double, d array<double>, b string, a int")
    assert workflow.digest(a) == workflow.digest(a.orderBy("b").repartition(3)) != workflow.digest(b)
    assert workflow.digest(a.where("false")) == "0:0" and workflow.digest(a.union(a)) != workflow.digest(a)
    with pytest.raises(FileNotFoundError):
        workflow.compared(spark, "file:///tmp/stylometra-none")
