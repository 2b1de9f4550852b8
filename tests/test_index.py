"""A real repository, walked, stored, analysed and reported."""

import json
import os
import shutil
import subprocess

import pytest

from chronofold.plans.index import index_repository, report_json, stats_report

pytestmark = pytest.mark.skipif(not shutil.which("git"), reason="no git here")


def git(repo, *args, at=1577836800, who="Ada", env=None):
    clock = {"GIT_AUTHOR_DATE": f"{at} +0200", "GIT_COMMITTER_DATE": f"{at} +0000", "GIT_AUTHOR_NAME": who, "GIT_AUTHOR_EMAIL": f"{who.lower()}@example.org", "GIT_COMMITTER_NAME": "Hub", "GIT_COMMITTER_EMAIL": "hub@example.org"}
    subprocess.run(["git", "-C", str(repo), *args], check=True, capture_output=True, env=os.environ | clock | (env or {}))


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    repo = tmp_path_factory.mktemp("repo")
    git(repo, "init", "-q", "-b", "main")
    steps = [
        ("Ada", "Add the parser with a first grammar", {"src/parser.rs": "a\n" * 40}),
        ("Bob", "fix: crash on empty input", {"src/parser.rs": "a\n" * 40 + "b\n"}),
        ("Ada", "Lock dependencies", {"Cargo.lock": "x\n" * 900}),
        ("Bob", "Move the parser\n\nIt belongs to the front end now, as the grammar does.\n\nCo-authored-by: Cy <cy@example.org>", {"src/parser.rs": None, "front/parser.rs": "a\n" * 40 + "b\n"}),
        ("Ada", "Add é paths", {"src/naïve é.py": "x\n"}),
        ("Bob", "Indent", {"front/parser.rs": "  a\n" * 40 + "b\n"}),
    ]
    for i, (who, message, files) in enumerate(steps):
        for path, text in files.items():
            target = repo / path
            if text is None:
                git(repo, "rm", "-q", path)
            else:
                target.parent.mkdir(parents=True, exist_ok=True)
                target.write_text(text)
                git(repo, "add", path)
        git(repo, "commit", "-q", "-m", message, at=1577836800 + 3600 * i, who=who)
    git(repo, "tag", "-a", "v1.0.0", "-m", "first")
    return repo


def test_index_and_report(spark, repo, tmp_path):
    store = index_repository(spark, str(repo), str(tmp_path / "index"))
    commits = store.read("commits").orderBy("commit_id").collect()
    assert [c["subject"] for c in commits] == ["Add the parser with a first grammar", "fix: crash on empty input", "Lock dependencies", "Move the parser", "Add é paths", "Indent"]
    assert commits[0]["authored_tz"] == 120 and commits[3]["n_trailers"] == 1
    assert store.read("parents").count() == 5 and store.integrity() == []
    files = {r["path"]: r for r in store.read("files").collect()}
    assert set(files) == {"front/parser.rs", "Cargo.lock", "src/naïve é.py"} and files["Cargo.lock"]["flags"] == 1
    assert store.read("file_aliases").where(f"file_id = {files['front/parser.rs']['file_id']}").count() == 2
    assert {r["name"]: r["commit_count"] for r in store.read("people").collect()} == {"Ada": 3, "Bob": 3, "Cy": 1, "Hub": 0}
    assert [r["name"] for r in store.read("tags").collect()] == ["v1.0.0"]
    report = json.loads(report_json(stats_report(store)))
    assert report["hotspots"][0]["path"] == "front/parser.rs" and report["hotspots"][0]["changes"] == 4
    flags = {r["subject"]: r["flags"] for r in report["significant"]}
    assert "lockfile-only" in flags["Lock dependencies"] and [s for s, f in flags.items() if "format-only" in f] == ["Indent"]
    assert report["people"][0] == {"name": "Ada", "commit_count": 3} and report["tail"] == [{"people": 0, "commits": 0}]
    assert store.meta()["index_state"] == "ready" and store.is_current("history", 1, commits[-1]["oid"])
    parser = files["front/parser.rs"]["file_id"]
    hunks = store.read("hunks").where(f"file_id = {parser}").orderBy("commit_id").collect()
    assert [(h["commit_id"], h["old_start"], h["old_len"], h["new_start"], h["new_len"], h["kind"]) for h in hunks] == [(1, None, None, 1, 40, 0), (2, None, None, 41, 1, 0), (6, 1, 40, 1, 40, 1)]
    assert {(r["name"], r["kind"], r["oid"]) for r in store.read("refs").collect()} == {(n, k, commits[-1]["oid"]) for n, k in (("refs/heads/main", "branch"), ("refs/tags/v1.0.0", "tag"))}
    again = index_repository(spark, str(repo), str(tmp_path / "index"))
    assert sorted(map(tuple, again.read("hotspots").collect())) == sorted(map(tuple, store.read("hotspots").collect()))


def test_a_failed_walk_is_marked(spark, tmp_path):
    from chronofold.sources.store import Store

    with pytest.raises(Exception):
        index_repository(spark, str(tmp_path / "none"), str(tmp_path / "index"))
    assert Store(spark, str(tmp_path / "index")).meta()["index_state"] == "failed"


def test_another_repository_is_refused(spark, repo, tmp_path):
    from chronofold.plans.index import identity_of
    from chronofold.sources.store import IndexError_, Store

    store = Store(spark, str(tmp_path / "index"))
    store.claim("of another one")
    with pytest.raises(IndexError_, match="REPO_MISMATCH"):
        index_repository(spark, str(repo), str(tmp_path / "index"))
    assert "index_state" not in store.meta() and len(identity_of(str(repo))) == 64


def test_a_table_set_aside_comes_back(spark, tmp_path):
    from chronofold.sources.store import Store

    store = Store(spark, str(tmp_path / "index"))
    store.replace("tags", spark.range(3))
    os.rename(tmp_path / "index/tags", tmp_path / "index/_old-tags")  # as a crash between the two renames leaves it
    assert store.read("tags").count() == 3
    store.replace("tags", spark.range(5))
    assert store.read("tags").count() == 5 and not (tmp_path / "index/_old-tags").exists()
