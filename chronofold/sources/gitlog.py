"""Readers of history streams: log records, hunks, mailmap, refs, trees. Each has a pure parser and a Spark reader.

A log file is split into records by Spark's own line reader (record separator \\x01), so files of any size are read in parallel;
each record is then parsed by itself in Arrow batches. Hunk streams are split at the commit lines in the same way.
"""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from chronofold.functions.fixed import HUNK_KINDS

RECORD, FIELD = "\x01", "\x02"
FIELDS = ["%H", "%T", "%P", "%an", "%ae", "%at", "%ai", "%cn", "%ce", "%ct", "%ci", "%B"]
FORMAT = "%x01" + "%x02".join(FIELDS) + "%x00"
PERSON = "struct<name:string,email:string>"
CHANGE = "struct<kind:string,old_path:string,new_path:string,similarity:int,insertions:int,deletions:int,is_binary:boolean>"
COMMIT = f"oid string, tree string, parents array<string>, author {PERSON}, committer {PERSON}, authored_at long, committed_at long, authored_tz int, committed_tz int, message string, changes array<{CHANGE}>"
HUNK = "oid string, path string, old_start int, old_len int, new_start int, new_len int, kind string"
KINDS = {"A": "add", "M": "modify", "D": "delete", "R": "rename", "C": "copy", "T": "modify"}


def walk_args(projection: str = "first-parent", since: str | None = None, renames: int = 50, copies: bool = False, every_ref: bool = False) -> list[str]:
    """Arguments of the log walk: parents come before children."""
    out = ["log", f"--format={FORMAT}", "--raw", "--numstat", "-z", "--no-abbrev", "--reverse", f"--find-renames={renames}%"]
    out.append("--author-date-order" if projection == "author-date" else "--topo-order")
    out += ["--find-copies"] * copies + ["--first-parent"] * (projection == "first-parent") + ["--all"] * every_ref
    return out + [f"{since}..HEAD" if since else "HEAD"] * (not every_ref)


def hunk_args(projection: str = "first-parent") -> list[str]:
    return ["-c", "core.quotePath=false", "log", "--patch", "--unified=0", "--no-color", "--format=%H", "--reverse", "--topo-order"] + ["--first-parent"] * (projection == "first-parent")


def offset_minutes(iso: str) -> int:
    """Minutes east of UTC at the end of an ISO time; anything odd, or more than a day, is 0."""
    m = re.search(r"([+-])(\d{2})(\d{2})\s*$", iso)
    if not m:
        return 0
    minutes = int(m[2]) * 60 + int(m[3])
    return 0 if minutes > 1440 else minutes if m[1] == "+" else -minutes


def parse_changes(section: str) -> list[dict]:
    """Changes from the NUL-separated part: status entries, then counts, joined by path."""
    tokens = [t for t in section.split("\0")]
    at, entries, counts = 0, [], {}
    while at < len(tokens):
        t = tokens[at].lstrip("\n")
        at += 1
        if t.startswith(":"):
            old_mode, new_mode, _, _, status = t[1:].split(" ")
            paths = 2 if status[0] in "RC" else 1
            names = tokens[at : at + paths]
            at += paths
            entries.append((status, old_mode != new_mode, names))
        elif "\t" in t:
            ins, dels, path = t.split("\t", 2)
            old = None
            if path == "":
                old, path = tokens[at], tokens[at + 1]
                at += 2
            counts[path] = (0 if ins == "-" else int(ins), 0 if dels == "-" else int(dels), ins == "-", old)
    out = []
    for status, mode_changed, names in entries:
        kind = KINDS.get(status[0], "modify")
        path = names[-1]
        ins, dels, binary, _ = counts.pop(path, (0, 0, False, None))
        if kind == "modify" and mode_changed and not ins and not dels and not binary:
            kind = "mode"
        old = names[0] if kind in ("rename", "copy", "delete", "modify", "mode") else None
        out.append({"kind": kind, "old_path": old, "new_path": None if kind == "delete" else path, "similarity": int(status[1:]) if status[1:].isdigit() else None, "insertions": ins, "deletions": dels, "is_binary": binary})
    for path, (ins, dels, binary, old) in counts.items():  # counts without a status: a plain edit, or a rename
        out.append({"kind": "rename" if old else "modify", "old_path": old or path, "new_path": path, "similarity": None, "insertions": ins, "deletions": dels, "is_binary": binary})
    return out


def parse_record(record: str) -> dict:
    """One commit of the log stream."""
    head, _, section = record.partition("\0")
    fields = head.split(FIELD)
    if len(fields) < len(FIELDS):
        raise ValueError(f"a log record has {len(fields)} of {len(FIELDS)} fields")
    oid, tree, parents, an, ae, at, ai, cn, ce, ct, ci = fields[:11]
    message = FIELD.join(fields[11:])
    return {
        "oid": oid, "tree": tree, "parents": parents.split(), "author": {"name": an, "email": ae}, "committer": {"name": cn, "email": ce}, "authored_at": int(at), "committed_at": int(ct),
        "authored_tz": offset_minutes(ai), "committed_tz": offset_minutes(ci), "message": re.sub(r"\r?\n\Z", "", message), "changes": parse_changes(section),
    }


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Commits of log files, with the file and walk_seq (order within the file). What stands before the first record is dropped."""
    # monotonically_increasing_id grows within a file in reading order, which is all that the rank below needs.
    lines = spark.read.option("lineSep", RECORD).text(path).select("value", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("seq"))
    records = lines.where(F.col("value").contains(FIELD))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [parse_record(v) | {"file": f, "walk_seq": s} for v, f, s in zip(pdf["value"], pdf["file"], pdf["seq"])]
            if rows:
                yield pd.DataFrame(rows)[["file", "walk_seq", *[x for x in rows[0] if x not in ("file", "walk_seq")]]]

    return records.mapInPandas(parse, f"file string, walk_seq long, {COMMIT}")


def is_whitespace_only(removed: list[str], added: list[str]) -> bool:
    squash = lambda lines: [s for s in (re.sub(r"\s+", "", x) for x in lines) if s]
    return squash(removed) == squash(added)


def parse_hunks(oid: str, patch: str) -> list[dict]:
    """Hunks of one commit's patch. Headers count before a file's first hunk only, so body lines can look like headers."""
    out, path, hunk, left = [], None, None, [0, 0]
    old_name = None

    def close():
        nonlocal hunk
        if hunk and path:
            removed, added = hunk.pop("r"), hunk.pop("a")
            out.append(hunk | {"kind": "whitespace-only" if is_whitespace_only(removed, added) else "content", "path": path})
        hunk = None

    for line in patch.split("\n"):
        if hunk and (left[0] or left[1]) and line[:1] in "-+\\":
            if line[:1] == "-":
                hunk["r"].append(line[1:])
                left[0] -= 1
            elif line[:1] == "+":
                hunk["a"].append(line[1:])
                left[1] -= 1
            continue
        if line.startswith("diff --git "):
            close()
            path = old_name = None
        elif line.startswith("--- ") and hunk is None:
            old_name = strip_prefix(line[4:])
        elif line.startswith("+++ ") and hunk is None:
            name = strip_prefix(line[4:])
            path = old_name if name == "/dev/null" else name
        elif m := re.match(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@", line):
            close()
            n = [int(m[2]) if m[2] is not None else 1, int(m[4]) if m[4] is not None else 1]
            hunk = {"oid": oid, "path": path, "old_start": int(m[1]), "old_len": n[0], "new_start": int(m[3]), "new_len": n[1], "r": [], "a": []}
            left = n[:]
    close()
    return out


def strip_prefix(name: str) -> str:
    name = name.split("\t", 1)[0]
    return re.sub(r"^[ab]/", "", name)


def read_hunks(spark: SparkSession, path: str) -> DataFrame:
    """Hunks of patch streams, one file a task: commits are told by bare id lines."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                for part in re.split(r"(?m)^(?=[0-9a-f]{40}(?:[0-9a-f]{24})?$)", content.decode("utf-8", "replace")):
                    oid, _, patch = part.partition("\n")
                    if rows := parse_hunks(oid, patch) if re.fullmatch("[0-9a-f]{40,64}", oid) else []:
                        yield pd.DataFrame(rows)[[x.split()[0] for x in HUNK.split(", ")]]

    return files.mapInPandas(parse, HUNK)


def attach_hunks(hunks: DataFrame, commits: DataFrame, changes: DataFrame) -> DataFrame:
    """Hunks with commit and file: the path is looked up among the commit's new paths, then its old ones. Empty sides become null, kinds their numbers."""
    known = hunks.join(commits.select("oid", "commit_id"), "oid")
    names = changes.select("commit_id", "file_id", F.col("new_path").alias("path"), F.lit(0).alias("rank")).unionByName(changes.select("commit_id", "file_id", F.col("old_path").alias("path"), F.lit(1).alias("rank")))
    first = names.where("path is not null").groupBy("commit_id", "path").agg(F.min(F.struct("rank", "file_id")).file_id.alias("file_id"))
    side = lambda start, n: [F.when(F.col(n) > 0, F.col(start)).alias(start), F.when(F.col(n) > 0, F.col(n)).alias(n)]
    code = (F.array_position(F.array(*[F.lit(k) for k in HUNK_KINDS]), F.col("kind")) - 1).cast("int").alias("kind")
    return known.join(first, ["commit_id", "path"]).select("commit_id", "file_id", *side("old_start", "old_len"), *side("new_start", "new_len"), code)


def parse_mailmap(text: str) -> list[tuple[str | None, str, str | None, str | None]]:
    """(name, email, to_name, to_email) of a mailmap's lines; name null: any name."""
    out = []
    for line in text.split("\n"):
        line = line.split("#", 1)[0].strip()
        m = re.fullmatch(r"([^<>]*)<([^<>]+)>\s*(?:([^<>]*)<([^<>]+)>)?\s*", line)
        if not m:
            continue
        to_name, first, name, second = (x.strip() if x else None for x in m.groups())
        if second is None:
            out.append((None, first.lower(), to_name or None, None))
        else:
            out.append((name or None, second.lower(), to_name or None, first))
    return out


def mailmap_table(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame(parse_mailmap(text), "name string, email string, to_name string, to_email string")


def parse_refs(text: str) -> list[tuple[str, str, str]]:
    """(name, kind, target) of lines "id type name [peeled id, type]"; tags of other things than commits are dropped."""
    out = []
    for line in text.splitlines():
        oid, kind, name, *peeled = line.split(" ")
        if kind == "tag" and len(peeled) == 2 and peeled[1] == "commit":
            oid, kind = peeled[0], "commit"
        if kind == "commit":
            place = next((k for p, k in (("refs/heads/", "branch"), ("refs/tags/", "tag"), ("refs/remotes/", "remote")) if name.startswith(p)), "other")
            out.append((name, place, oid))
    return out


def parse_tree(text: str) -> list[tuple[int, str, str, int | None, str]]:
    """(mode, type, oid, size, path) of a NUL-separated recursive tree listing."""
    out = []
    for entry in filter(None, text.split("\0")):
        m = re.fullmatch(r"(\d+) (\w+) ([0-9a-f]{40,64})\s+(-|\d+)\t(.*)", entry, re.S)
        if not m:
            raise ValueError(f"not a tree entry: {entry!r}")
        out.append((int(m[1], 8), m[2], m[3], None if m[4] == "-" else int(m[4]), m[5]))
    return out


def tree_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Paths that differ between two tree snapshots (path, oid): added, deleted, modified."""
    x, y = a.select("path", F.col("oid").alias("old_oid")), b.select("path", F.col("oid").alias("new_oid"))
    both = x.join(y, "path", "full").where("old_oid is distinct from new_oid")
    return both.withColumn("kind", F.when(F.col("old_oid").isNull(), "add").when(F.col("new_oid").isNull(), "delete").otherwise("modify"))


def parse_ignore_revs(text: str) -> list[str]:
    """Full ids of an ignore-revs file; a shortened one is an error."""
    out = []
    for line in text.splitlines():
        oid = line.split("#", 1)[0].strip()
        if not oid:
            continue
        if not re.fullmatch(r"[0-9a-f]{40}|[0-9a-f]{64}", oid):
            raise ValueError(f"not a full commit id: {oid}")
        out.append(oid)
    return out


class RepositorySource(DataSource):
    """``spark.read.format("history").option("repositories", "a,b")``: walks repositories by the git program, one task each."""

    @classmethod
    def name(cls) -> str:
        return "history"

    def schema(self) -> str:
        return f"repo_id string, walk_seq long, {COMMIT}"

    def reader(self, schema) -> DataSourceReader:
        return _RepositoryReader(self.options)


class _RepositoryReader(DataSourceReader):
    def __init__(self, options):
        self.paths = [p for p in options.get("repositories", "").split(",") if p]
        self.args = walk_args(options.get("projection", "first-parent"), options.get("since"))

    def partitions(self):
        return [InputPartition(p) for p in self.paths]

    def read(self, partition):
        run = subprocess.Popen(["git", "-C", partition.value, *self.args], stdout=subprocess.PIPE)
        held, seq, said = b"", 0, False
        for block in iter(lambda: run.stdout.read(1 << 20), b""):
            said = said or bool(block.strip())
            *whole, held = (held + block).split(RECORD.encode())
            for raw in whole:
                if FIELD.encode() in raw:
                    yield self._row(partition.value, seq, raw)
                    seq += 1
        if FIELD.encode() in held:
            yield self._row(partition.value, seq, held)
            seq += 1
        if run.wait():
            raise RuntimeError(f"git failed in {partition.value}")
        if said and not seq:
            raise RuntimeError(f"the log of {partition.value} has no records")

    @staticmethod
    def _row(repo: str, seq: int, raw: bytes):
        r = parse_record(raw.decode("utf-8", "replace"))
        person = lambda p: (p["name"], p["email"])
        return (repo, seq, r["oid"], r["tree"], r["parents"], person(r["author"]), person(r["committer"]), r["authored_at"], r["committed_at"], r["authored_tz"], r["committed_tz"], r["message"], [tuple(c.values()) for c in r["changes"]])


class HunkSource(DataSource):
    """Spark source of the hunks of repositories' histories: options repositories (comma-separated), projection. A commit's patch is held at a time."""

    @classmethod
    def name(cls) -> str:
        return "history_hunks"

    def schema(self) -> str:
        return f"repo_id string, {HUNK}"

    def reader(self, schema) -> DataSourceReader:
        return _HunkReader(self.options)


class _HunkReader(DataSourceReader):
    def __init__(self, options):
        self.paths = [p for p in options.get("repositories", "").split(",") if p]
        self.args = hunk_args(options.get("projection", "first-parent"))

    def partitions(self):
        return [InputPartition(p) for p in self.paths]

    def read(self, partition):
        run = subprocess.Popen(["git", "-C", partition.value, *self.args], stdout=subprocess.PIPE)
        names, oid, patch = [x.split()[0] for x in HUNK.split(", ")], None, []

        def told():
            for hunk in parse_hunks(oid, "\n".join(patch)) if oid else []:
                yield (partition.value, *(hunk[n] for n in names))

        # Lines of a patch begin with a mark, so a bare id is always the next commit.
        for raw in run.stdout:
            line = raw.decode("utf-8", "replace").removesuffix("\n")
            if re.fullmatch("[0-9a-f]{40}|[0-9a-f]{64}", line):
                yield from told()
                oid, patch = line, []
            else:
                patch.append(line)
        yield from told()
        if run.wait():
            raise RuntimeError(f"git failed in {partition.value}")
