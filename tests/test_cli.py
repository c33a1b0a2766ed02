import json

import pytest

from tessera import cli


def test_search_and_status(spark, tmp_path, capsys, monkeypatch):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.txt").write_text("A lamp stands near the window of the old harbour house, all night.")
    base = ["--index", "file://" + str(tmp_path / "ix"), "--dim", "16"]
    say = lambda *x: (cli.main([*base, *x]), [json.loads(line) for line in capsys.readouterr().out.splitlines()])[1]
    assert say("update", str(src))[0]["changed"] == 1
    assert say("search", "lamp", "--keyword-only")[0]["path"].endswith("a.txt")
    assert [e["stage"] for e in say("stream", "lamp")] == ["keyword", "encoding", "semantic", "done"]
    assert say("status")[0]["files"] == 1
    assert say("matrix")[0]["rows"] == 1 and say("verify")[0]["passed"]
    assert say("candidates-build")[0] == {"rows": 1, "cells": 1}
    (tmp_path / "my_scorer.py").write_text("def by_length(pairs):\n    return [float(len(t)) for _, t in pairs]\n")
    spark.sparkContext.addPyFile(str(tmp_path / "my_scorer.py"))
    monkeypatch.syspath_prepend(str(tmp_path))
    models = ["--encoder", "tessera.engine:HashEncoder", "--scorer", "my_scorer:by_length"]
    base += models
    assert [e["stage"] for e in say("stream", "lamp", "--early", "--rerank", "--rerank-limit", "5", "--rerank-mix", "0.5")] == ["keyword", "encoding", "candidates", "reranked_early", "semantic", "refined", "reranked", "done"]
    (src / "b.docx").write_bytes(b"junk")
    assert say("update", str(src), "--batch-files", "1")[0]["changed"] == 1 and say("errors")[0]["phase"] == "extract"
    assert say("metrics") == [] and say("stats")[0]["passages"] == 1 and say("repair-truncated") == [{"repaired": 0}] and say("metadata-upgrade")
    assert say("search", "lamp", "--refresh")[0]["path"].endswith("a.txt")


def test_start_does_not_wait(spark, tmp_path, capsys, monkeypatch):
    started = []
    monkeypatch.setattr(cli.subprocess, "Popen", lambda command, **options: started.append((command, options)))
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.txt").write_text("A lamp stands near the window of the old harbour house, all night.")
    base = ["--index", "file://" + str(tmp_path / "ix"), "--dim", "16"]
    say = lambda *x: (cli.main([*base, *x]), [json.loads(line) for line in capsys.readouterr().out.splitlines()])[1]
    say("update", str(src))
    job = say("start", "lamp", "--keyword-only")[0]["job"]
    assert say("poll", job)[0]["state"] == "starting" and started[0][0][-2:] == ["work", job] and started[0][1]["start_new_session"]
    say("work", job)
    assert say("poll", job)[0]["state"] == "done" and [e["stage"] for e in say("poll", job)[0]["events"]] == ["keyword", "done"]


def test_scopes_are_kept(tmp_path, capsys):
    at = str(tmp_path / "scopes.json")
    assert cli.main(["--index", "x", "--scopes", at, "scope", "docs", "/docs", "--priority", "5"]) == 0
    assert json.loads(open(at).read())["collections"]["docs"]["priority"] == 5
    with pytest.raises(ValueError, match="invalid_scope_name"):
        cli.main(["--index", "x", "--scopes", at, "scope", "Docs!", "/docs"])
