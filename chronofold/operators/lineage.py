"""Identities that depend on order: people across spellings, files across renames.

Both are folds over one repository's history in walk order, so they run grouped by repository (``applyInPandas``), one task a
repository; repositories run in parallel. A history is bounded by its repository (a million commits are about 5 million changes).
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from chronofold.functions import columns as C
from chronofold.functions import fixed as V


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Jaro-Winkler of two columns."""
    return pd.Series([None if x is None or y is None else C.jaro_winkler(x, y) for x, y in zip(a, b)], dtype="float64")


def similar_names(names: DataFrame, least: float = V.NAME_SIMILARITY) -> DataFrame:
    """(a, b, similarity) of all pairs a < b of different names (name) that are similar enough.

    Exact candidates: the similarity is at most j + 0.4 (1 - j), so j >= (least - 0.4) / 0.6, and each name shares at least
    ``part`` = 3 j - 2 of its characters with the other. Characters (with their number in the name) are taken rarest first; two
    such names meet in the first n - ceil(part n) + 1 of them, and their lengths differ by no more than that share.
    """
    part = 3 * (least - 0.4) / 0.6 - 2
    rows = names.select("name").where("name <> ''").distinct()
    if part <= 0:
        raise ValueError("a similarity that low allows any pair")
    chars = F.split("name", "")
    signs = rows.select("name", F.length("name").alias("n"), F.posexplode(chars).alias("i", "c"), chars.alias("all"))
    signs = signs.select("name", "n", F.concat("c", F.size(F.filter(F.slice("all", F.lit(1), F.col("i") + 1), lambda x: x == F.col("c"))).cast("string")).alias("sign"))
    often = signs.groupBy("sign").agg(F.count(F.lit(1)).alias("often"))
    rank = F.row_number().over(Window.partitionBy("name").orderBy("often", "sign"))
    first = signs.join(often, "sign").withColumn("rank", rank).where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * part - 1e-9) + 1).select("name", "n", "sign")
    a, b = first.select(F.col("name").alias("a"), F.col("n").alias("na"), "sign"), first.select(F.col("name").alias("b"), F.col("n").alias("nb"), "sign")
    pairs = a.join(b, "sign").where((F.col("a") < F.col("b")) & (F.least("na", "nb") >= part * F.greatest("na", "nb") - 1e-9)).select("a", "b").distinct()
    return pairs.select("a", "b", similarity(F.col("a"), F.col("b")).alias("similarity")).where(F.col("similarity") >= least)


# -- files -----------------------------------------------------------------------------------------------------
class FileHistory:
    """The files of one repository, as changes come in walk order.

    ``at`` maps a path to the file that lives there, ``grave`` a path to the last file that died there. Deletes and displacements
    bury, a rename does not: an add at a deleted path brings the file back, one at a renamed-away path makes a new file.
    """

    def __init__(self):
        self.at: dict[str, int] = {}
        self.grave: dict[str, int] = {}
        self.born: dict[int, int] = {}
        self.died: dict[int, int | None] = {}
        self.copied: dict[int, int | None] = {}
        self.spans: list[list] = []  # file, path, from, to
        self.open: dict[int, int] = {}  # file -> its open span

    def _enter(self, file: int, path: str, commit: int) -> int:
        self.at[path] = file
        self.open[file] = len(self.spans)
        self.spans.append([file, path, commit, None])
        return file

    def _leave(self, file: int, path: str, commit: int) -> None:
        del self.at[path]
        self.spans[self.open.pop(file)][3] = commit

    def _new(self, path: str, commit: int, source: int | None = None) -> int:
        file = len(self.born) + 1
        self.born[file], self.died[file], self.copied[file] = commit, None, source
        return self._enter(file, path, commit)

    def _bury(self, path: str, commit: int) -> int:
        file = self.at[path]
        self._leave(file, path, commit)
        self.died[file], self.grave[path] = commit, file
        return file

    def step(self, commit: int, kind: str, old: str | None, new: str | None) -> int | None:
        """The file that a change is about."""
        if kind == "delete":
            path = old if old is not None else new
            return self._bury(path, commit) if path in self.at else None
        target = new if kind in ("add", "rename", "copy") else (new if new is not None else old)
        if target is None or (kind == "rename" and old is None):
            return None
        if kind == "add" and target in self.grave:
            file = self.grave.pop(target)
            if target in self.at:
                raise ValueError(f"{target} is live and buried at commit {commit}")
            self.died[file] = None
            return self._enter(file, target, commit)
        if kind == "rename" and old in self.at:
            file = self.at[old]
            self._leave(file, old, commit)
            if target in self.at:
                self._bury(target, commit)
            return self._enter(file, target, commit)
        if target in self.at:
            return self.at[target]
        return self._new(target, commit, self.at.get(old) if kind == "copy" and old is not None else None)


def resolve_files(changes: DataFrame) -> DataFrame:
    """changes (repo_id, commit_id, ordinal, kind, old_path, new_path) with file_id; a change of nothing known has none.

    Within a commit deletes come first.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        h = FileHistory()
        pdf = pdf.assign(_late=pdf["kind"] != "delete").sort_values(["commit_id", "_late", "ordinal"], kind="stable")
        rows = zip(pdf["commit_id"], pdf["kind"], pdf["old_path"], pdf["new_path"])
        pdf["file_id"] = pd.array([h.step(int(c), k, _text(o), _text(n)) for c, k, o, n in rows], dtype="Int64")
        return pdf.drop(columns="_late")

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in changes.schema.fields) + ", file_id long"
    return changes.groupBy("repo_id").applyInPandas(fold, schema)


ALIASES = "repo_id string, file_id long, path string, from_commit long, to_commit long, born_commit long, died_commit long, copied_from long"


def file_aliases(changes: DataFrame) -> DataFrame:
    """Paths of each file over time (half-open in commits), with its birth, death and copy source."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        h = FileHistory()
        pdf = pdf.assign(_late=pdf["kind"] != "delete").sort_values(["commit_id", "_late", "ordinal"], kind="stable")
        for c, k, o, n in zip(pdf["commit_id"], pdf["kind"], pdf["old_path"], pdf["new_path"]):
            h.step(int(c), k, _text(o), _text(n))
        rows = [(pdf["repo_id"].iloc[0], f, p, a, z, h.born[f], h.died[f], h.copied[f]) for f, p, a, z in h.spans]
        out = pd.DataFrame(rows, columns=[x.split()[0] for x in ALIASES.split(", ")])
        return out.astype({c: "Int64" for c in out.columns if c not in ("repo_id", "path")})

    return changes.groupBy("repo_id").applyInPandas(fold, ALIASES)


def _text(x) -> str | None:
    return x if isinstance(x, str) else None


# -- people ----------------------------------------------------------------------------------------------------
def _email(e: str) -> str:
    e = e.strip().lower()
    local, sep, domain = e.rpartition("@")
    if not sep or not local:
        return e
    if domain == "users.noreply.github.com":
        return re.sub(r"^\d+\+", "", local) + "@" + domain
    plus = local.find("+")
    local = local[:plus] if plus > 0 else local
    return (local.replace(".", "") if domain in ("gmail.com", "googlemail.com") else local) + "@" + domain


def _name(n: str) -> str:
    return re.sub(r"\s+", " ", re.sub("[.,_]", " ", n.strip().lower()))


def _bot(name: str, email: str) -> bool:
    hit = lambda patterns, s: any(re.search(p, s.strip(), re.I) for p in patterns)
    return _name(name) in V.MERGE_QUEUES or hit(V.BOT_EMAILS, email) or hit(V.BOT_NAMES, name)


class Away:
    """Times of activity of people by number, and who was not active at a time: a tree of the latest first and the earliest last times."""

    def __init__(self):
        self.size, self.count = 1, 0
        self.first, self.last = [-math.inf] * 2, [math.inf] * 2

    def set(self, i: int, first: float, last: float) -> None:
        while i >= self.size:
            n, f, z = self.size, self.first, self.last
            self.size, self.first, self.last = 2 * n, [-math.inf] * (4 * n), [math.inf] * (4 * n)
            for k in range(n):
                self._put(k, f[n + k], z[n + k])
        self._put(i, first, last)

    def _put(self, i: int, first: float, last: float) -> None:
        f, z, i = self.first, self.last, i + self.size
        f[i], z[i] = first, last
        while i > 1:
            i >>= 1
            a, b = max(f[2 * i], f[2 * i + 1]), min(z[2 * i], z[2 * i + 1])
            if f[i] == a and z[i] == b:
                break
            f[i], z[i] = a, b

    def next(self, start: int, before: float, after: float) -> int | None:
        """The first from ``start`` on who was first seen behind ``before`` or last seen ahead of ``after``."""
        if start >= self.size:
            return None
        f, z, n, i = self.first, self.last, self.size, start + self.size
        while True:
            if f[i] > before or z[i] < after:
                while i < n:
                    i *= 2
                    if not (f[i] > before or z[i] < after):
                        i += 1
                return i - n
            while i & 1:
                i >>= 1
            if not i:
                return None
            i += 1


class Directory:
    """The people of one repository, as sightings come in order.

    A sighting belongs to the first person that answers to its address, then to its normalised address, then to its name within
    the address's domain; last, to the first human of a very similar name who was not active within a month of it. Keys stay
    with the first who had them; two known people never become one.
    """

    def __init__(self):
        self.people: list[dict] = []
        self.by_email: dict[str, int] = {}
        self.by_name: dict[tuple[str, str], int] = {}
        self.known: dict[tuple[str, str], int] = {}
        self.away = Away()

    def see(self, name: str, email: str, to_name: str, to_email: str, at: int, role: str) -> int:
        mapped = (to_name, to_email) != (name, email)
        if not mapped and (who := self.known.get((name, email))) is not None:  # found by its own address before: only times and counts change
            p = self.people[who]
            if at < p["first"] or at > p["last"]:
                p["first"], p["last"] = min(p["first"], at), max(p["last"], at)
                self._active(who, p)
            p["commits"] += role in ("author", "co-author")
            return who + 1
        exact, plain, key = to_email.strip().lower(), _email(to_email), _name(to_name)
        domain = plain.rpartition("@")[2] if "@" in plain else ""
        if exact in self.by_email:
            who, rule = self.by_email[exact], "exact-email"
        elif plain in self.by_email:
            who, rule = self.by_email[plain], "normalized-email"
        elif key and domain and (key, domain) in self.by_name:
            who, rule = self.by_name[key, domain], "name-and-domain"
        else:
            who, rule = (self._similar(key, at) if key else None), "heuristic"
        # By name or similarity, these say how; found by address, a mailmap entry does.
        source = "mailmap" if mapped and rule in ("exact-email", "normalized-email") else rule
        if who is None:
            who = len(self.people)
            self.people.append({"name": to_name, "email": to_email, "first": at, "last": at, "commits": 0, "source": "mailmap" if mapped else "exact-email", "bot": False, "identities": {}})
        else:
            p = self.people[who]
            if source == "mailmap" or (p["source"] != "mailmap" and V.MERGE_SOURCES.index(source) > V.MERGE_SOURCES.index(p["source"])):
                p["source"] = source
        for k in (exact, plain):
            if k:
                self.by_email.setdefault(k, who)
        if key and domain:
            self.by_name.setdefault((key, domain), who)
        p = self.people[who]
        if mapped:
            p["name"], p["email"] = to_name, to_email
        p["key"] = _name(p["name"])
        identity = (name, email)
        p["identities"].setdefault(identity)
        if not mapped and rule == "exact-email":
            self.known[identity] = who
        p["first"], p["last"] = min(p["first"], at), max(p["last"], at)
        p["commits"] += role in ("author", "co-author")
        p["bot"] = p["bot"] or _bot(name, email)
        self._active(who, p)
        return who + 1

    def _active(self, who: int, p: dict) -> None:
        """Bots are never taken for another."""
        self.away.set(who, *((-math.inf, math.inf) if p["bot"] else (p["first"], p["last"])))

    def _similar(self, key: str, at: int) -> int | None:
        i = -1
        while (i := self.away.next(i + 1, at + V.OVERLAP_SECONDS, at - V.OVERLAP_SECONDS)) is not None:
            if C.jaro_winkler(key, self.people[i]["key"]) >= V.NAME_SIMILARITY:
                return i
        return None


PEOPLE = "repo_id string, person_id long, canonical_name string, canonical_email string, first_seen long, last_seen long, commit_count long, merge_source string, is_bot boolean, name string, email string"


_SEEN = ("name", "email", "to_name", "to_email", "seen_at", "role")


def _by_repository(sightings: DataFrame) -> DataFrame:
    """In order (commit, co-authors (0), author (1), committer (2)), all of a repository in one task, which lets them pass."""
    tasks = int(sightings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sightings.repartition(tasks, "repo_id").sortWithinPartitions("repo_id", "commit_id", "role_seq", "ordinal")


def resolve_people(sightings: DataFrame) -> DataFrame:
    """sightings (repo_id, commit_id, role_seq, ordinal, name, email, to_name, to_email, seen_at, role) with person_id.

    Order: commit, then co-authors (0), author (1), committer (2).
    """

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        repo, d = None, Directory()
        for pdf in parts:
            who = []
            for r, *seen in zip(pdf["repo_id"], *(pdf[c] for c in _SEEN)):
                if r != repo:
                    repo, d = r, Directory()
                who.append(d.see(*seen[:4], int(seen[4]), seen[5]))
            yield pdf.assign(person_id=who)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sightings.schema.fields) + ", person_id long"
    return _by_repository(sightings).mapInPandas(fold, schema)


def people(sightings: DataFrame) -> DataFrame:
    """One row for each identity of each person."""
    names = [x.split()[0] for x in PEOPLE.split(", ")]

    def rows(repo: str, d: Directory) -> Iterator[pd.DataFrame]:
        out = ((repo, i + 1, p["name"], p["email"], p["first"], p["last"], p["commits"], p["source"], p["bot"], n, e) for i, p in enumerate(d.people) for n, e in p["identities"])
        while some := list(itertools.islice(out, 10_000)):
            yield pd.DataFrame(some, columns=names)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        repo, d = None, Directory()
        for batch in batches:
            for r, n, e, tn, te, at, role in zip(*(c.to_pylist() for c in batch.columns)):
                if r != repo:
                    yield from rows(repo, d)
                    repo, d = r, Directory()
                d.see(n, e, n if tn is None else tn, e if te is None else te, at, role)
        yield from rows(repo, d)

    # What a mailmap leaves as it is does not travel twice.
    narrow = [F.nullif(F.col(f"to_{c}"), F.col(c)).alias(f"to_{c}") for c in ("name", "email")]
    ordered = _by_repository(sightings.select("repo_id", "commit_id", "role_seq", "ordinal", "name", "email", *narrow, F.col("seen_at").cast("long").alias("seen_at"), "role"))
    types = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    schema = pa.schema([(x.split()[0], types[x.split()[1]]) for x in PEOPLE.split(", ")])
    emit = lambda batches: (pa.RecordBatch.from_pandas(pdf, schema=schema, preserve_index=False) for pdf in fold(batches))
    return ordered.select("repo_id", *_SEEN).mapInArrow(emit, PEOPLE)


def sightings_of(commits: DataFrame, mailmap: DataFrame | None = None) -> DataFrame:
    """Sightings of commits (repo_id, commit_id, author, committer: struct<name, email>, authored_at, committed_at, message).

    mailmap (name, email, to_name, to_email; null name: any; null to_*: unchanged) is small and joined by broadcast: an entry with the
    commit's name beats one without.
    """
    trailers = C.trailers_of(F.col("message"))

    def row(who: Column, at: str, role: str, seq: int) -> Column:
        return F.struct(who["name"].alias("name"), who["email"].alias("email"), F.col(at).alias("seen_at"), F.lit(role).alias("role"), F.lit(seq).alias("role_seq"))

    helpers = F.transform(C.co_authors(trailers), lambda c: F.struct(c["name"].alias("name"), c["email"].alias("email"), F.col("authored_at").alias("seen_at"), F.lit("co-author").alias("role"), F.lit(0).alias("role_seq")))
    every = F.concat(helpers, F.array(row(F.col("author"), "authored_at", "author", 1), row(F.col("committer"), "committed_at", "committer", 2)))
    rows = commits.select("repo_id", "commit_id", F.posexplode(every).alias("ordinal", "s")).select("repo_id", "commit_id", "ordinal", "s.*")
    if mailmap is None:
        return rows.withColumns({"to_name": F.col("name"), "to_email": F.col("email")})
    key = F.lower(F.trim("email"))
    named = mailmap.where("name is not null").select(F.lower("email").alias("_k"), F.lower("name").alias("_n"), F.col("to_name").alias("_tn"), F.col("to_email").alias("_te"))
    general = mailmap.where("name is null").select(F.lower("email").alias("_g"), F.col("to_name").alias("_gn"), F.col("to_email").alias("_ge"))
    out = rows.join(F.broadcast(named), (key == F.col("_k")) & (F.lower("name") == F.col("_n")), "left").join(F.broadcast(general), key == F.col("_g"), "left")
    hit = F.col("_k").isNotNull()
    to_name = F.coalesce(F.when(hit, F.col("_tn")).otherwise(F.col("_gn")), F.col("name"))
    to_email = F.coalesce(F.when(hit, F.col("_te")).otherwise(F.col("_ge")), F.col("email"))
    return out.withColumns({"to_name": to_name, "to_email": to_email}).drop("_k", "_n", "_tn", "_te", "_g", "_gn", "_ge")


