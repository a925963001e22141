"""The driver entry and the command line."""

import json

import __spark_entry__
from codestrata import cli


def test_entry_has_a_stable_schema(spark):
    got = __spark_entry__.entry(spark)
    assert got.columns == ["metric_id", "language", "cohort", "state", "numerator", "denominator", "value", "reason"]
    assert got.count() > 0


def test_every_oracle_has_a_query():
    assert {*__spark_entry__.oracle_sql()} <= {*__spark_entry__.queries()}


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.py").write_text("v = True if f() else False\nw = 1\n")
    assert cli.main(["scan", "--root", str(tmp_path), "--json"]) == 0
    report = json.loads(capsys.readouterr().out)
    found = {(m["cohort"], m["metric_id"]): m.get("value") for m in report["metrics"]}
    assert found["production", "verbosity.patterns"] == 0.5 and found["test", "erosion"] is None
    assert cli.main(["findings", "--root", str(tmp_path), "--rule", "py.boolean-conditional"]) == 0
    assert "py.boolean-conditional" in capsys.readouterr().out
    assert cli.main(["explain", "--root", str(tmp_path), "--path", "no.py"]) == 2
    assert cli.main(["rules"]) == 0 and "py.redundant-pass" in capsys.readouterr().out
    assert cli.main(["tree", "--root", str(tmp_path)]) == 0
    (tmp_path / "bad.py").write_text("def f(:\n")
    assert cli.main(["scan", "--root", str(tmp_path), "--strict"]) == 3
