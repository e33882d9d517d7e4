import json

import pytest

from tenure import __main__ as cli

SF = "/root/testdata/sf0.001"


def test_list(capsys):
    assert cli.main(["list"]) == 0
    assert "q01_switch_contrast" in capsys.readouterr().out.split()


def test_run_and_render(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setattr(cli, "session", lambda: spark)
    assert cli.main(["run", "--sf", SF, "--out", str(tmp_path), "g23_transition_statistics"]) == 0
    text = next((tmp_path / "manifest").glob("part-*")).read_text()
    assert json.loads("".join(text.splitlines()))["stages"][0]["status"] == "ok"
    assert cli.main(["render", "--out", str(tmp_path), "g23_transition_statistics"]) == 0
    assert "cf & " in capsys.readouterr().out


def test_unknown_names_are_refused():
    with pytest.raises(SystemExit):
        cli.main(["run", "nothing", "--sf", SF, "--out", "x"])
