"""The driver's entry module and the command line."""

import json

import __spark_entry__ as entry_module
from pactum.__main__ import main


def test_entry(spark):
    out = entry_module.entry(spark)
    assert out.count() == 10 and out.columns == ["rule", "violations"]


def test_every_oracle_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_command_line(tmp_path, capsys):
    (tmp_path / "contract.yaml").write_text('$version: "0.1.0"\ntables: [{name: t, columns: [{name: a, type: number, examples: [1]}], constraints: [{assert: a > 0}]}]\n')
    assert main(["validate-spec", str(tmp_path)]) == 0
    assert "warning[S09]" in capsys.readouterr().out
    assert main(["translate", str(tmp_path), "--expr", "a + 1", "--to", "R"]) == 0
    assert json.loads(capsys.readouterr().out)[0]["translations"] == [{"target": "R(base)", "code": "a + 1L"}]
    assert main(["export-spec", str(tmp_path)]) == 0
    assert json.loads(capsys.readouterr().out)["tables"][0]["columns"][0]["type"] == "number"
    (tmp_path / "contract.yaml").write_text("tables: 3\n")
    assert main(["validate-spec", str(tmp_path), "--json"]) == 1
