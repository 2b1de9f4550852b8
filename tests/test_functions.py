"""Scalar functions on literal inputs."""

import pytest
from pyspark.sql import functions as F

from chronofold.functions import columns as C
from chronofold.functions import fixed as V


def values(spark, inputs, make, kind="string"):
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r["y"] for r in frame.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


def test_paths(spark):
    paths = ["a/b.test.ts", ".gitignore", "dist/x.js", "vendor/a.go", "Cargo.lock", "src/regenerate.py", "lints.generated.ts", "img/Logo.PNG", "x/test_a.py", "test_a.py", "lib.rs.html", ".yarn/releases/y.js"]
    assert values(spark, paths, C.extension) == ["ts", "", "js", "go", "lock", "py", "ts", "png", "py", "py", "html", "js"]
    assert values(spark, paths, C.file_flags) == [4, 0, 1, 2, 1, 0, 1, 8, 0, 4, 1, 2]
    assert values(spark, ["a.rs", "b.TSX", "c", ".py", "d.unknown"], C.language) == ["Rust", "TypeScript", None, None, None]
    assert values(spark, ["a/b/c", "d"], C.top_directory) == ["a", None]


def test_message_parts(spark):
    messages = [
        "one",
        "one\n\nbody here\n\nCo-authored-by: Ada L <ada@x.org>\nSigned-Off-By: B\n  continued",
        "one\r\n\r\nNote: this is\nnot a trailer block",
        "s\n\n  indented: no trailer",
        "s\n\nFixes: 12",
        "",
    ]
    got = values(spark, messages, C.message_parts)
    assert [g["subject"] for g in got] == ["one", "one", "one", "s", "s", ""]
    assert [g["body"] for g in got] == [None, "body here", "Note: this is\nnot a trailer block", "indented: no trailer", None, None]
    assert [[tuple(t) for t in g["trailers"]] for g in got] == [[], [("co-authored-by", "Ada L <ada@x.org>"), ("signed-off-by", "B continued")], [], [], [("fixes", "12")], []]
    helpers = values(spark, messages[1:2], lambda x: C.co_authors(C.message_parts(x)["trailers"]))
    assert [tuple(h) for h in helpers[0]] == [("Ada L", "ada@x.org")]


def test_subjects(spark):
    assert values(spark, ["fix: a", "prefix it", "fixes crash", "Hotfix x", "add bugle"], C.is_fix) == [True, False, True, True, False]
    assert values(spark, ["chore: reformat", "run prettier", "style(x): apply formatting", "black magic", "blackbird", "rework"], C.is_mechanical) == [True, True, True, True, False, False]


def test_people(spark):
    emails = ["Ada.L+git@Gmail.com", "123+ada@users.noreply.github.com", "+x@y.org", "no-at", " A@B.org ", "@x.org"]
    assert values(spark, emails, C.normal_email) == ["adal@gmail.com", "ada@users.noreply.github.com", "+x@y.org", "no-at", "a@b.org", "@x.org"]
    assert values(spark, ["Ada_Love.Lace", "  A  B "], C.normal_name) == ["ada love lace", "a b"]
    assert values(spark, ["bors", "Boris", "dependabot[bot]", "Ada"], lambda x: C.is_bot(x, F.lit("a@b.c"))) == [True, False, True, False]
    assert values(spark, ["actions@github.com", "noreply@github.com", "a@b.c"], lambda x: C.is_bot(F.lit("A"), x)) == [True, True, False]


@pytest.mark.parametrize("a, b, want", [("martha", "marhta", 0.961111), ("dwayne", "duane", 0.84), ("dixon", "dicksonx", 0.813333), ("", "a", 0.0), ("a", "a", 1.0), ("ab", "cd", 0.0)])
def test_jaro_winkler(a, b, want):
    assert C.jaro_winkler(a, b) == pytest.approx(want, abs=1e-6)


def test_scores(spark):
    assert values(spark, [0, 50, 1000], lambda x: C.saturating(x, 50), "long") == [0.0, 1.0, 1.0]
    assert values(spark, [0], lambda x: C.recency(F.lit(365 * 86400), x), "long")[0] == pytest.approx(0.5)
    assert values(spark, ["a\n\tb\n\n    c", ""], C.complexity) == [3 * (1 + 9 / 3 / 4), 0.0]
    quality = values(spark, ["", "wip", "a subject of some length"], lambda x: C.stored_quality(x, F.lit(True), F.lit(1), F.lit(False)))
    assert quality == pytest.approx([0.0, 0.35, 1.0])


def test_codes(spark):
    assert values(spark, [5, 0, 1024], lambda x: C.flag_names(x, V.COMMIT_FLAGS), "int") == [["merge", "revert"], [], ["bulk-mechanical"]]
    assert values(spark, V.CHANGE_KINDS, lambda x: C.kind_code(x, V.CHANGE_KINDS, 1)) == [1, 2, 3, 4, 5, 6]
    with pytest.raises(Exception, match="unknown kind"):
        values(spark, ["odd"], lambda x: C.kind_code(x, V.CHANGE_KINDS, 1))
    assert values(spark, [0], lambda x: C.iso_with_offset(x, F.lit(-330)), "long") == ["1969-12-31T18:30:00-05:30"]


def test_cursors_and_targets():
    assert C.decode_cursor(C.encode_cursor(1577836800, 42)) == (1577836800, 42)
    assert [C.decode_cursor(x) for x in ("", "!!", "YQ", C.encode_cursor(1, 2)[:-2])] == [None] * 4
    assert C.line_target("a:b.py:12") == ("a:b.py", 12)
    for bad in ("a.py", "a.py:0", ":3"):
        with pytest.raises(ValueError):
            C.line_target(bad)
    assert C.page_size(5000) == 1000
    with pytest.raises(ValueError):
        C.page_size(0)
