"""Folds, readers, store, searches and evidence on small inline tables."""

import random

import pytest
from pyspark.sql import functions as F

from chronofold.operators import evidence as E
from chronofold.operators import lineage, lookups
from chronofold.operators import rollups as R
from chronofold.sources import gitlog
from chronofold.sources.store import IndexError_, Store, dense_ids, intern_paths, merged
from chronofold.streaming import timeline


def history(*steps):
    """File ids of (commit, kind, old, new) steps, and the fold."""
    h = lineage.FileHistory()
    return [h.step(*s) for s in steps], h


def aliases(h):
    return [(f, p, a, z) for f, p, a, z in h.spans]


CASES = {
    "rename": ([(1, "add", None, "a"), (2, "rename", "a", "b")], [1, 1], [(1, "a", 1, 2), (1, "b", 2, None)]),
    "chain": ([(1, "add", None, "a"), (2, "rename", "a", "b"), (3, "rename", "b", "c")], [1, 1, 1], [(1, "a", 1, 2), (1, "b", 2, 3), (1, "c", 3, None)]),
    "back": ([(1, "add", None, "a"), (2, "rename", "a", "b"), (3, "rename", "b", "a")], [1, 1, 1], [(1, "a", 1, 2), (1, "b", 2, 3), (1, "a", 3, None)]),
    "resurrection": ([(1, "add", None, "a"), (2, "delete", "a", None), (5, "add", None, "a")], [1, 1, 1], [(1, "a", 1, 2), (1, "a", 5, None)]),
    "add at a renamed-away path": ([(1, "add", None, "a"), (2, "rename", "a", "b"), (3, "add", None, "a")], [1, 1, 2], [(1, "a", 1, 2), (1, "b", 2, None), (2, "a", 3, None)]),
    "copy": ([(1, "add", None, "a"), (2, "copy", "a", "b")], [1, 2], [(1, "a", 1, None), (2, "b", 2, None)]),
    "displacement": ([(1, "add", None, "a"), (2, "add", None, "b"), (3, "rename", "a", "b")], [1, 2, 1], [(1, "a", 1, 3), (2, "b", 2, 3), (1, "b", 3, None)]),
    "unknown source": ([(1, "rename", "x", "y"), (2, "modify", "z", "z"), (3, "delete", "q", None)], [1, 2, None], [(1, "y", 1, None), (2, "z", 2, None)]),
}


@pytest.mark.parametrize("case", CASES)
def test_file_history(case):
    steps, ids, spans = CASES[case]
    got, h = history(*steps)
    assert got == ids and aliases(h) == spans
    for f in h.born:  # aliases of a file do not overlap, only the last may be open
        own = [(a, z) for g, _, a, z in h.spans if g == f]
        assert all(z is not None and z <= b for (_, z), (b, _) in zip(own, own[1:]))


def test_files_by_repository(spark):
    rows = [("r1", 2, 1, "add", None, "a"), ("r1", 2, 0, "delete", "a", None), ("r1", 1, 0, "add", None, "a"), ("r2", 1, 0, "add", None, "z")]
    df = spark.createDataFrame(rows, "repo_id string, commit_id long, ordinal int, kind string, old_path string, new_path string")
    got = {(r["repo_id"], r["commit_id"], r["ordinal"]): r["file_id"] for r in lineage.resolve_files(df).collect()}
    assert got == {("r1", 1, 0): 1, ("r1", 2, 0): 1, ("r1", 2, 1): 1, ("r2", 1, 0): 1}
    assert lineage.file_aliases(df).count() == 3
    assert lineage.file_aliases(df.limit(0)).count() == 0


def see(d, name, email, at=0, role="author", to=None):
    return d.see(name, email, *(to or (name, email)), at, role)


def test_people():
    d = lineage.Directory()
    assert see(d, "Ada Lovelace", "ada@x.org") == 1
    assert see(d, "Ada", "ADA@x.org") == 1
    assert see(d, "Ada", "ada+git@x.org") == 1 and d.people[0]["source"] == "normalized-email"
    assert see(d, "ada lovelace", "al@x.org") == 1 and d.people[0]["source"] == "name-and-domain"
    assert see(d, "Ada Lovelace", "ada@other.org", at=10) == 2  # active at the time
    assert see(d, "Ada Lovelacy", "ada@third.org", at=400 * 86400) == 1 and d.people[0]["source"] == "heuristic"
    assert see(d, "dependabot[bot]", "d@x") == 3 and d.people[2]["bot"]
    assert see(d, "A.L.", "old@x.net", to=("Ada Lovelace", "ada@x.org")) == 1
    assert d.people[0]["source"] == "mailmap" and d.people[0]["name"] == "Ada Lovelace"
    see(d, "Ada", "ada@x.org", role="committer")
    assert d.people[0]["commits"] == 6


def test_sightings_with_mailmap(spark):
    commit = [("r", 1, ("Ada", "a@x"), ("Hub", "h@x"), 5, 6, "s\n\nCo-authored-by: Bob <b@x>"), ("r", 2, ("Joe", "c@x"), ("Joe", "c@x"), 7, 7, "t")]
    person = "struct<name:string,email:string>"
    df = spark.createDataFrame(commit, f"repo_id string, commit_id long, author {person}, committer {person}, authored_at long, committed_at long, message string")
    mailmap = gitlog.mailmap_table(spark, "Ada L <ada@x> <a@x>\nJoseph <c@x>\n# none\n")
    rows = lineage.sightings_of(df, mailmap).orderBy("commit_id", "role_seq").collect()
    assert [(r["role"], r["to_name"], r["to_email"]) for r in rows] == [("co-author", "Bob", "b@x"), ("author", "Ada L", "ada@x"), ("committer", "Hub", "h@x"), ("author", "Joseph", "c@x"), ("committer", "Joseph", "c@x")]
    who = lineage.people(lineage.sightings_of(df, mailmap)).collect()
    assert {(r["canonical_name"], r["merge_source"]) for r in who} == {("Bob", "exact-email"), ("Ada L", "mailmap"), ("Hub", "exact-email"), ("Joseph", "mailmap")}


def record(oid, message, section="", at=100):
    fields = [oid, "t" * 40, "p" * 40, "Ada", "a@x", str(at), "2020-01-01 00:00:00 +0530", "Ada", "a@x", str(at), "2020-01-01 00:00:00 -0100", message + "\n"]
    return "\x01" + "\x02".join(fields) + "\0" + section


def test_log_records(spark, tmp_path):
    raw = ":100644 100644 aaa bbb M\0a.py\0:100644 100644 aaa bbb R090\0old é.py\0new é.py\0:100644 100755 aaa bbb M\0run\0:000000 100644 000 bbb A\0i.png\0"
    counts = "3\t1\ta.py\0" + "2\t2\t\0old é.py\0new é.py\0" + "0\t0\trun\0" + "-\t-\ti.png\0"
    text = "noise before" + record("a" * 40, "subject\n\nbody\x02with field mark", "\n\0" + raw + counts) + record("b" * 40, "empty")
    (tmp_path / "log.bin").write_text(text)
    rows = gitlog.read_log(spark, str(tmp_path / "log.bin")).orderBy("walk_seq").collect()
    assert [r["oid"][0] for r in rows] == ["a", "b"] and rows[0]["message"] == "subject\n\nbody\x02with field mark" and rows[1]["changes"] == []
    assert (rows[0]["authored_tz"], rows[0]["committed_tz"]) == (330, -60)
    got = [(c["kind"], c["old_path"], c["new_path"], c["similarity"], c["insertions"], c["deletions"], c["is_binary"]) for c in rows[0]["changes"]]
    assert got == [("modify", "a.py", "a.py", None, 3, 1, False), ("rename", "old é.py", "new é.py", 90, 2, 2, False), ("mode", "run", "run", None, 0, 0, False), ("add", None, "i.png", None, 0, 0, True)]
    with pytest.raises(ValueError):
        gitlog.parse_record("too\x02few")


def test_hunks(spark, tmp_path):
    patch = "\n".join(
        ["c" * 40, "", "diff --git a/x b/x", "--- a/a file\t", "+++ b/a file\t", "@@ -1 +1,2 @@ ctx", "--- not a header", "+++ nor this", "+two", "@@ -9,0 +11 @@", "+last",
         "diff --git a/w b/w", "--- a/w", "+++ b/w", "@@ -3 +3 @@", "-a  b", "+ a b", "diff --git a/gone b/gone", "--- a/gone", "+++ /dev/null", "@@ -1,2 +0,0 @@", "-x", "-y", "d" * 40, ""]
    )
    (tmp_path / "h").write_text(patch)
    got = [tuple(r) for r in gitlog.read_hunks(spark, str(tmp_path / "h")).collect()]
    c = "c" * 40
    assert got == [(c, "a file", 1, 1, 1, 2, "content"), (c, "a file", 9, 0, 11, 1, "content"), (c, "w", 3, 1, 3, 1, "whitespace-only"), (c, "gone", 1, 2, 0, 0, "content")]
    hunks = spark.createDataFrame(got, gitlog.HUNK)
    commits = spark.createDataFrame([(7, c)], "commit_id long, oid string")
    changes = spark.createDataFrame([(7, 1, "a file", "a file"), (7, 2, "w", "w"), (7, 3, None, "gone")], "commit_id long, file_id long, new_path string, old_path string")
    rows = gitlog.attach_hunks(hunks, commits, changes).orderBy("file_id", "new_start").collect()
    assert [(r["file_id"], r["old_start"], r["new_start"]) for r in rows] == [(1, 1, 1), (1, None, 11), (2, 3, 3), (3, 1, None)]


def test_small_parsers(spark):
    assert gitlog.parse_refs(f"{'a' * 40} commit refs/heads/main\n{'b' * 40} tag refs/tags/v1 {'c' * 40} commit\n{'d' * 40} blob refs/tags/x") == [("refs/heads/main", "branch", "a" * 40), ("refs/tags/v1", "tag", "c" * 40)]
    assert gitlog.parse_tree(f"100644 blob {'a' * 40}      12\tx y\0" + f"160000 commit {'b' * 40}       -\tsub\0") == [(33188, "blob", "a" * 40, 12, "x y"), (57344, "commit", "b" * 40, None, "sub")]
    assert gitlog.parse_ignore_revs(f"# why\n{'a' * 40} # here\n\n") == ["a" * 40]
    with pytest.raises(ValueError):
        gitlog.parse_ignore_revs("abc123")
    assert gitlog.parse_mailmap("New <n@x> Old <o@x>\n<n@x> <p@x>\nName <q@x>") == [("Old", "o@x", "New", "n@x"), (None, "p@x", None, "n@x"), (None, "q@x", "Name", None)]
    a, b = (spark.createDataFrame(r, "path string, oid string") for r in ([("a", "1"), ("b", "2")], [("b", "3"), ("c", "4")]))
    assert sorted((r["path"], r["kind"]) for r in gitlog.tree_diff(a, b).collect()) == [("a", "delete"), ("b", "modify"), ("c", "add")]
    assert gitlog.walk_args(since="abc")[-1] == "abc..HEAD" and "--first-parent" in gitlog.walk_args()


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "index"))
    s.claim("r1")
    with pytest.raises(IndexError_, match="REPO_MISMATCH"):
        s.claim("r2")
    commits = spark.createDataFrame([(1,), (2,)], "commit_id long")
    s.append("commits", commits, ["commit_id"])
    with pytest.raises(IndexError_, match="DUPLICATE_ROW"):
        s.append("commits", commits, ["commit_id"])
    s.replace("parents", spark.createDataFrame([(2, 1, 0), (3, 2, 0)], "child_id long, parent_id long, ordinal int"))
    assert s.integrity() == ["parents.child_id: 1 without commits"]
    s.upsert("people", spark.createDataFrame([(1, "a")], "person_id long, name string"), ["person_id"])
    s.upsert("people", spark.createDataFrame([(1, "b"), (2, "c")], "person_id long, name string"), ["person_id"])
    assert sorted(map(tuple, s.read("people").collect())) == [(1, "b"), (2, "c")]
    s.record_run("hotspots", 2, "tip")
    assert s.is_current("hotspots", 2, "tip") and not s.is_current("hotspots", 3, "tip")
    s.set_meta("note", "x")
    for bad in ("schema_version", "index_state"):
        with pytest.raises(ValueError):
            s.set_meta(bad, "1")
    s._put({"schema_version": "99"})
    with pytest.raises(IndexError_, match="SCHEMA_TOO_NEW"):
        Store(spark, str(tmp_path / "index"))


def test_ids(spark):
    df = spark.range(100).select((F.lit(1000) - F.col("id")).alias("seen"))
    assert [r["i"] for r in dense_ids(df, ["seen"], "i").orderBy("seen").collect()] == list(range(1, 101))
    paths = spark.createDataFrame([("b", 1), ("a", 2), ("b", 3)], "path string, seen long")
    first = intern_paths(paths)
    assert {r["path"]: r["path_id"] for r in first.collect()} == {"b": 1, "a": 2}
    again = intern_paths(spark.createDataFrame([("c", 1), ("a", 2)], "path string, seen long"), first)
    assert {r["path"]: r["path_id"] for r in again.collect()} == {"b": 1, "a": 2, "c": 3}
    assert merged(first, first, ["path"]).count() == 2


def test_pages_cover_all(spark):
    commits = spark.range(1, 61).select(F.col("id").alias("commit_id"), F.floor(F.col("id") / 25).alias("committed_at"))
    seen, after = [], None
    while True:
        page = [tuple(r) for r in lookups.commit_page(commits.select("committed_at", "commit_id"), 7, after).collect()]
        seen += page[:7]
        if len(page) <= 7:
            break
        after = page[6]
    assert seen == sorted(seen, reverse=True) and len(set(seen)) == 60


@pytest.mark.parametrize("query", ["foo (", "C++", '"unbalanced', "NEAR(", "*", "a AND", "-x", ""])
def test_hostile_search(spark, query):
    texts = spark.createDataFrame([(1, "foo near c a and x"), (2, "Résumé")], "id long, text string")
    lookups.search_commits(texts, query, 5).collect()


def test_search_and_ranges(spark):
    texts = spark.createDataFrame([(1, "alpha beta"), (2, "alpha alpha betas"), (3, "Résumé alphabet")], "id long, text string")
    assert [r["id"] for r in lookups.search_commits(texts, "alpha bet", 5).collect()] == [2, 1]
    assert [r["id"] for r in lookups.search_commits(texts, "resum", 5).collect()] == [3]
    hunks = spark.createDataFrame([(1, 1, 10, 5), (2, 1, 15, 1), (3, 1, 1, 300), (4, 2, 10, 5)], "commit_id long, file_id long, new_start long, new_len long")
    commits = spark.createDataFrame([(1, 5), (2, 5), (3, 4), (4, 9)], "commit_id long, committed_at long")
    assert [r["commit_id"] for r in lookups.commits_touching(hunks, commits, 1, 14, 16).collect()] == [2, 1, 3]
    assert lookups.commits_touching(hunks, commits, 1, 900, 901).count() == 0
    with pytest.raises(ValueError):
        lookups.commits_touching(hunks, commits, 1, 5, 5)
    ranges = spark.createDataFrame([(1, 14, 200)], "file_id long, start long, end long")
    assert lookups.overlapping_hunks(hunks, ranges).count() == 3


def test_ancestry(spark):
    parents = spark.createDataFrame([(2, 1), (3, 1), (4, 2), (4, 3), (5, 4), (7, 6)], "child_id long, parent_id long")
    from chronofold.sources.store import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    start = spark.createDataFrame([(4,)], "commit_id long")
    assert sorted(r[0] for r in lookups.ancestors(parents, start).collect()) == [1, 2, 3, 4]
    one = F.lit("r").alias("repo_id")
    folded = lookups.ancestors_by_repository(parents.select(one, "*"), start.select(one, "*"))
    assert sorted(r["commit_id"] for r in folded.collect()) == [1, 2, 3, 4]
    assert lookups.is_ancestor(parents, spark, 2, 5) and not lookups.is_ancestor(parents, spark, 6, 5) and not lookups.is_ancestor(parents, spark, 5, 2)
    assert [lookups.update_kind(a, b, parents, spark) for a, b in ((None, 1), (4, 4), (4, 5), (6, 5))] == ["rewritten", "up-to-date", "fast-forward", "rewritten"]


def tables(spark, changes, commits):
    c = spark.createDataFrame(commits, "commit_id long, author_id long, authored_at long, subject string, has_body boolean, n_trailers int")
    x = spark.createDataFrame(changes, "commit_id long, file_id long, insertions long, deletions long, is_binary boolean")
    return c.withColumn("committed_at", F.col("authored_at")), x


DAY = 86400


def test_islands(spark):
    """One who left owns a file; an active owner's, a shared and a handed-over file are no islands."""
    commits = [(1, 1, 0, "a", False, 0), (2, 2, 1000 * DAY, "b", False, 0), (3, 3, 1000 * DAY, "c", False, 0), (4, 4, 1000 * DAY, "d", False, 0)]
    changes = [(1, 1, 100, 0, False), (2, 2, 100, 0, False), *[(c, 3, 50, 0, False) for c in (2, 3, 4)], (1, 4, 5, 0, False), (2, 4, 400, 0, False)]
    c, x = tables(spark, changes, commits)
    files = spark.createDataFrame([(i, f"src/{i}.rs") for i in range(1, 5)], "file_id long, path string")
    people = spark.createDataFrame([(i, False) for i in range(1, 5)], "person_id long, is_bot boolean")
    now = F.lit(1000 * DAY)
    known = R.knowledge(R.source_changes(x, c, files))
    out = {r["file_id"]: (r["is_island"], r["bus_factor"]) for r in R.islands(R.ownership(known, people, now), R.last_seen(c), now).collect()}
    assert out == {1: (True, 1), 2: (False, 1), 3: (False, 2), 4: (False, 1)}


def test_noise_scores_below_work(spark):
    commits = [(1, 1, 0, "Rewrite the walker so that parents always precede children", True, 1), (2, 1, 1, "apply formatting", False, 0), (3, 1, 2, "bump", False, 0), (4, 1, 3, "nothing", False, 0)]
    changes = [(1, 1, 80, 10, False), (1, 2, 5, 5, False), *[(2, f, 10, 10, False) for f in range(1, 41)], (3, 100, 500, 400, False)]
    c, x = tables(spark, changes, commits)
    files = spark.createDataFrame([*[(i, f"src/{i}.rs") for i in range(1, 41)], (100, "Cargo.lock")], "file_id long, path string")
    parents = spark.createDataFrame([(2, 1, 0), (3, 2, 0), (4, 3, 0)], "child_id long, parent_id long, ordinal int")
    tags = spark.createDataFrame([], "tag_id long, name string, target_id long, tagged_at long")
    got = {r["commit_id"]: r for r in R.significance(c, x, files, parents, tags).collect()}
    assert got[1]["significance"] > got[2]["significance"] and got[1]["significance"] > got[3]["significance"] and got[4]["significance"] == 0
    assert got[1]["flags"] == 2 and got[2]["flags"] == 1024 and got[3]["flags"] & 512 and got[4]["flags"] == 16


def test_reverts(spark):
    commits = spark.createDataFrame([(1, "a" * 40, "x"), (2, "b" * 40, "This reverts commit aaaaaaaaaaaa."), (3, "c" * 40, "This reverts commit ddddddd.")], "commit_id long, oid string, message string")
    assert [tuple(r) for r in E.reverts_named(commits).collect()] == [(2, 1)]
    hunks = spark.createDataFrame([(1, 1, 5, 0, 5, 3), (2, 1, 5, 3, 5, 0), (3, 1, 5, 1, 5, 3)], "commit_id long, file_id long, old_start int, old_len int, new_start int, new_len int")
    assert [tuple(r) for r in E.reverts_inverse(hunks).collect()] == [(2, 1)]
    named, inverse = E.reverts_named(commits), E.reverts_inverse(hunks)
    rows = E.links([(named, "observed", "message"), (inverse, "observed", "diff")]).collect()
    assert [(r["from_id"], r["to_id"], r["source"]) for r in rows] == [("2", "1", "message")]


def test_citations_and_segments(spark):
    import numpy as np

    said = [(1, "A 7 [E1]. B 1.2 [E2].", ["E1", "E2"], ["7 and 8", "v1.2"]), (2, "A [E1]. B [E9].", ["E1"], [""]), (3, "A [E1]. B.", ["E1"], [""]), (4, "", [], []), (5, "A 77 [E1].", ["E1", "E2"], ["7 and 8", "77"]), (6, "A [E1]. B [E1]. C [E1]. D.", ["E1"], [None])]
    answers = spark.createDataFrame(said, "id long, text string, labels array<string>, sources array<string>")
    assert {r["id"]: r["verdict"] for r in E.check_citations(answers).collect()} == {1: "accept", 2: "reject", 3: "reject", 4: "reject", 5: "reject", 6: "downgrade"}
    x = np.concatenate([np.zeros(40), np.full(30, 9.0), np.full(50, -5.0)])[:, None]
    assert E.segment(x) == [0, 40, 70]
    cells = E.squarify([6, 6, 4, 3, 2, 2, 1], 0, 0, 6, 4)
    assert [round(w * h, 6) for _, _, w, h in cells] == [6, 6, 4, 3, 2, 2, 1]


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"2024-01-0{1 + i % 3} 10:00:00", i % 2, "view", 1.0) for i in range(30)], "event_id long, ts string, user_id long, event_type string, value double")
    rows.withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(str(tmp_path / "events"))
    stream = timeline.events_stream(spark, str(tmp_path / "events"))
    got = timeline.run_to_memory(timeline.windowed_counts(stream), "test_windows")
    assert sorted(r["events"] for r in got.collect()) == [10, 10, 10]
    store = Store(spark, str(tmp_path / "store"))
    timeline.load_incrementally(timeline.events_stream(spark, str(tmp_path / "events")), store, "events", ["event_id"], str(tmp_path / "cp"))
    timeline.load_incrementally(timeline.events_stream(spark, str(tmp_path / "events")), store, "events", ["event_id"], str(tmp_path / "cp2"))
    assert store.read("events").count() == 30 and store.meta()["index_state"] == "ready"
    assert timeline.sessions(spark.read.parquet(str(tmp_path / "events"))).count() == 6


def test_similar_names_are_all_pairs(spark):
    from chronofold.functions.columns import jaro_winkler

    rng = random.Random(6)
    names = {"".join(rng.choice("abcd e") for _ in range(rng.randint(1, 9))) for _ in range(150)} | {"jon smith", "john smith", "jon smyth", "smith jon", "a", "aa"}
    names |= {n[:-1] + "x" for n in list(names) if len(n) > 4}
    want = {(a, b) for a in names for b in names if a < b and jaro_winkler(a, b) >= 0.92}
    got = lineage.similar_names(spark.createDataFrame([(n,) for n in [*names, "", None, "a"]], "name string")).collect()
    assert {(r["a"], r["b"]) for r in got} == want and len(got) == len(want) > 20


def test_references(spark):
    rows = [(1, "fix (#12) and (#13)"), (2, "Merge pull request #7 from a/b"), (3, "x\n\nbody\n\nPR-URL: https://h/o/r/pull/55\nChange-Id: I" + "0a" * 20), (4, "nothing #5"), (5, "y (#55)\n\nPR-URL: https://h/o/r/pull/55")]
    frame = spark.createDataFrame([(i, m, m.split("\n")[0]) for i, m in rows], "commit_id long, message string, subject string")
    got = sorted(map(tuple, E.references(frame).collect()))
    assert got == [(1, "pull-request", "12"), (1, "pull-request", "13"), (2, "pull-request", "7"), (3, "change-id", "I" + "0a" * 20), (3, "pull-request", "55"), (5, "pull-request", "55")]


def test_eras_snap_to_the_nearest_release(spark):
    import datetime as dt

    day = dt.date(2020, 1, 6)
    rows = [(day + dt.timedelta(weeks=i), (5 if i < 40 else 50 if i < 80 else 9) + i % 4, 2, 0.5, 1, 0.0) for i in range(120)]
    series = spark.createDataFrame(rows, "week date, commits long, authors long, entropy double, loc_delta long, extension_mix double")
    at = lambda d: int(dt.datetime(d.year, d.month, d.day, tzinfo=dt.timezone.utc).timestamp())
    week40, week80 = day + dt.timedelta(weeks=40), day + dt.timedelta(weeks=80)
    tags = spark.createDataFrame([(at(week40 + dt.timedelta(days=x)),) for x in (-5, 5, 30)] + [(at(week80 + dt.timedelta(days=20)),)], "tagged_at long")
    got = {r["era"]: r["start"] for r in E.eras(series, tags).collect()}
    assert got[1] == day and week40 - dt.timedelta(days=5) in got.values() and week80 in got.values()


def test_treemap_covers_the_whole_in_path_order(spark):
    rows = [("a", "a/1", 30), ("a", "a/2", 10), ("b", "b/1", 60)]
    got = {r["path"]: r for r in E.treemap(spark.createDataFrame(rows, "directory string, path string, size long"), 100.0, 100.0).collect()}
    assert {p: round(r["w"] * r["h"]) for p, r in got.items()} == {"a/1": 3000, "a/2": 1000, "b/1": 6000}
    place = [(got[p]["x"], got[p]["y"]) for p in ("a/1", "a/2", "b/1")]
    assert place == [(0.0, 0.0), (75.0, 0.0), (0.0, 40.0)]


def test_reverts_of_common_subjects(spark):
    """A revert finds the last commit before it of its subject and file; a subject of many commits makes no pairs of them."""
    said = [(i, "Revert tidy up" if i % 2 else "feat: tidy up (#%d)" % i) for i in range(1, 401)] + [(500, "fix:  (#14)"), (501, "Revert  (#7)"), (502, "Revert tidy up"), (503, "Revert ")]
    messages = spark.createDataFrame(said, "commit_id long, subject string")
    changes = spark.createDataFrame([(i, f) for i, _ in said for f in (i % 3, 7)] + [(502, 9), (4, 9)], "commit_id long, file_id long")
    found = E.revert_pairs_by_message(messages, changes)
    assert {tuple(r) for r in found.collect()} == {(i, i - 1) for i in range(3, 401, 2)} | {(501, 500), (502, 400)}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_trailers_are_those_of_the_whole_message(spark):
    """Only the last paragraph is looked at, and the trailers are the same as of a message that is taken apart whole."""
    from chronofold.functions import columns as C

    rng = random.Random(8)
    parts = ["a", "Key: v", "pr-url: x/pull/7", "\n", "\n\n", "\r\n", "\r\n\r\n", " more", "\n\n\n", "text: not\nA: b", " ", "\t", "", "\n \n", "X-Y: é\n  folded", "\x0b"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 7))) for _ in range(1500)] + [None]
    frame = spark.createDataFrame([(t,) for t in texts], "message string")
    got = frame.select("message", C.message_parts(F.col("message"))["trailers"].alias("a"), C.trailers_of(F.col("message")).alias("b")).collect()
    assert all((r["a"] or []) == (r["b"] or []) for r in got) and sum(bool(r["b"]) for r in got) > 100
    plan = E.references(frame.select(F.lit(1).alias("commit_id"), "message", F.lit("s").alias("subject")))._jdf.queryExecution().optimizedPlan().toString()
    assert "split(regexp_replace(rtrim" not in plan.lower()


def test_evidence_is_ranked_in_one_shuffle_by_target(spark):
    items = spark.createDataFrame([("t", k, c, p, s) for c in (1, 2, 3) for k, p, s in (("blame", 0.5, "observed"), ("commit-context", 0.5, "observed"), ("pr-reference", 0.8, "observed"))], "target string, kind string, commit_id long, proximity double, confidence string")
    commits = spark.createDataFrame([(1, 0), (2, DAY), (3, 2 * DAY)], "commit_id long, authored_at long")
    ranked = E.rank_evidence(items, commits, F.lit(2 * DAY))
    assert [(r["label"], r["kind"], r["commit_id"]) for r in ranked.orderBy("label").collect()] == [("E1", "pr-reference", 3), ("E2", "pr-reference", 2), ("E3", "pr-reference", 1)]
    assert ranked._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(target") == 1


def test_pieces_without_words_are_no_sentences(spark):
    said = [(1, "[E1] Ñó. One word. Two words. Three."), (2, "[E1] "), (3, "One. [E1]"), (4, "[E1] ?! One."), (5, "One [E1]. [E1]"), (6, "One. [E1] Two.")]
    answers = spark.createDataFrame([(i, t, ["E1"], [t]) for i, t in said], "id long, text string, labels array<string>, sources array<string>")
    assert {r["id"]: r["ratio"] for r in E.check_citations(answers).collect()} == {1: 0.333333, 2: 0.0, 3: 1.0, 4: 1.0, 5: 1.0, 6: 0.5}


def test_squarify_looks_at_each_size_once():
    """The same rectangles as rows that are summed and compared anew for each size, in time that grows with the sizes only."""
    import time

    def plain(sizes, x, y, w, h):
        total, out, at = sum(sizes), [], 0
        scale = w * h / total if total else 0.0
        areas = [s * scale for s in sizes]
        while at < len(areas):
            side, row, worst = min(w, h), [], float("inf")
            while at + len(row) < len(areas):
                trial = [*row, areas[at + len(row)]]
                s = sum(trial)
                ratio = max(max(side * side * a / (s * s), s * s / (side * side * a)) if a else float("inf") for a in trial) if s else 1.0
                if row and ratio > worst:
                    break
                row, worst = trial, ratio
            thick, pos = sum(row) / side if side else 0.0, 0.0
            for a in row:
                long = a / thick if thick else 0.0
                out.append((x, y + pos, thick, long) if w >= h else (x + pos, y, long, thick))
                pos += long
            x, w, y, h = (x + thick, w - thick, y, h) if w >= h else (x, w, y + thick, h - thick)
            at += len(row)
        return out

    rng = random.Random(4)
    for n in (0, 1, 2, 7, 300, 3000):
        for most in (1, 9, 100_000):
            sizes = [float(rng.randint(0, most)) for _ in range(n)]
            assert E.squarify(sizes, 0.0, 0.0, 1000.0, 700.0) == plain(sizes, 0.0, 0.0, 1000.0, 700.0)
    began = time.process_time()
    assert len(E.squarify([1.0] * 300_000, 0.0, 0.0, 1000.0, 1000.0)) == 300_000
    assert time.process_time() - began < 20


@pytest.mark.parametrize("ordered", [True, False])
def test_ancestors_part_by_part(spark, ordered):
    """Parts of eight ids, edges across many of them, parents without edges of their own, two repositories; ids in any order still work."""
    rng = random.Random(5)
    edges = {(r, c, c - rng.choice((1, 1, 3, 7, 40))) for r in "ab" for c in range(-30, 200) if rng.random() < 0.8 for _ in range(rng.choice((1, 2)))}
    edges |= set() if ordered else {("a", 3, 90)}
    start = [("a", 150), ("a", 60), ("b", 77), ("c", 5)]
    want = set(start)
    while more := {(r, p) for r, c, p in edges if (r, c) in want} - want:
        want |= more
    parents = spark.createDataFrame(sorted(edges), "repo_id string, child_id long, parent_id long")
    found = lookups.ancestors_by_repository(parents, spark.createDataFrame(start, "repo_id string, commit_id long"), bits=3)
    got = [tuple(r) for r in found.collect()]
    assert set(got) == want and len(got) == len(want)
    assert ("FlatMapCoGroups" in found._jdf.queryExecution().optimizedPlan().toString()) != ordered


def test_people_are_found_without_going_through_all():
    """Who is similar and away is found as by going through all people in order, with few comparisons of names."""
    from chronofold.functions import columns as C

    class Plain(lineage.Directory):
        def _similar(self, key, at):
            for i, p in enumerate(self.people):
                away = at < p["first"] - 30 * DAY or at > p["last"] + 30 * DAY
                if not p["bot"] and away and C.jaro_winkler(key, p["key"]) >= 0.92:
                    return i

    rng = random.Random(2)
    names = [f"{a}#{i:04d}{b}" for i in range(250) for a, b in (("Customer", ""), ("Helper", "[bot]" if i % 9 == 0 else ""), (rng.choice("xyzw") * 9, ""))]
    seen = [(n, f"{n}{rng.randrange(3)}@x.org", rng.randrange(2000) * DAY) for n in rng.choices(names, k=4000)]
    a, b = lineage.Directory(), Plain()
    assert [see(a, *s) for s in seen] == [see(b, *s) for s in seen] and a.people == b.people
    away = lineage.Away()
    for i in range(5000):
        away.set(i, 0, 100)
    away.set(4321, 50, 60)
    assert away.next(0, 40, -1) == 4321 and away.next(4322, 40, -1) is None


def test_tasks_of_coupling_grow_with_the_changes(spark, monkeypatch):
    changes = spark.createDataFrame([(c, f) for c in range(200) for f in (c % 5, 5 + c % 3, 9)], "commit_id long, file_id long")
    want = {tuple(r) for r in R.coupling(changes).collect()}
    monkeypatch.setattr(R, "CHANGES_PER_TASK", 50)
    found = R.coupling(changes)
    assert {tuple(r) for r in found.collect()} == want and len(want) == 5 * 3 + 5 + 3
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(commit_id#" in plan and plan.count(", 12), REPARTITION_BY_NUM") >= 2


def test_texts_do_not_travel_for_significance(spark):
    import re

    c, x = tables(spark, [(i, i % 3, 5, 5, False) for i in range(9)], [(i, 1, i, "Subject %d" % (i % 2), True, 1) for i in range(9)])
    files = spark.createDataFrame([(i, f"src/{i}.rs") for i in range(3)], "file_id long, path string")
    parents = spark.createDataFrame([(1, 0, 0)], "child_id long, parent_id long, ordinal int")
    tags = spark.createDataFrame([], "tag_id long, name string, target_id long, tagged_at long")
    plan = R.significance(c, x, files, parents, tags)._jdf.queryExecution()
    told = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(plan, "formatted")
    sent = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*?)\]", told)
    assert sent and not [s for s in sent if re.search(r"(^|, )subject#", s)], sent
