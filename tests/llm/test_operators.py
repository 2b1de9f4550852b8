"""The training-data operators against plain versions on small tables, and on awkward ones: nulls, empty and very long texts,
ties, repeated rows, extra columns with clashing names, empty tables."""

import collections
import hashlib
import os
import random
import re
import warnings
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chronofold.llm import chosen_path, encoding, exact_dedup, line_rules, mixing, neighbour_quality, packing, secret_scan, suffix_dedup, token_files, url_filter
from chronofold.llm.encoding import WordEncoder

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, sha string, row string, cls long, n long, kept string"
LABELS = "doc_id long, quality int, toxic int"
SPACE = re.compile("[\x20\x09-\x0d]")
WORD = re.compile("[^\x20\x09-\x0d]+")


def sentence(rng, n):
    return " ".join("".join(rng.choice(["ta", "ri", "no", "el", "sh", "un", "é"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def texts(seed=1):
    """Plain texts with exact copies, near copies, shared passages, odd white space and lengths from none to long."""
    rng = random.Random(seed)
    base = [sentence(rng, rng.choice([0, 1, 3, 12, 60, 200])) for _ in range(30)]
    base += [base[5], base[5] + " ", base[20].replace(" ", "\n"), "", "   ", "a", "tab\there  two", "x\n\n\ny ", "日本語 テスト. İ", "<|endoftext|> a"]
    passage = sentence(rng, 30)
    base += [sentence(rng, 20) + "\n" + passage + "\n" + sentence(rng, 20) for _ in range(4)]
    long = base[25] if len(base[25].split()) > 100 else sentence(rng, 200)
    for i in range(4):
        w = long.split(" ")
        w[10 + 7 * i] = "changed"
        base.append(" ".join(w))
    base += [" ".join(["again"] * 80), sentence(rng, 20_000), "The " * 60, "line one here.\nline one here.\nline two"]
    return base


@pytest.fixture(scope="module")
def rows():
    out = [(i, t, "en" if i % 3 else "fr", f"s{i % 4}", len(t), 1, "x", "y", 2, 3, "z") for i, t in enumerate(texts())]
    out += [(200, None, None, None, None, None, None, None, None, None, None), (None, "no id here at all", "en", "s", 1, 1, "", "", 1, 1, ""), (None, None, None, None, None, None, None, None, None, None, None)]
    return out + [out[7], out[7], (7, "other text of the same id", "de", "s", 1, 1, "", "", 1, 1, "")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3, "n_chars")


@pytest.fixture(scope="module")
def labels(spark, rows):
    marks = [(r[0], int("again" not in (r[1] or "") and "The The" not in (r[1] or "")), 0) for r in rows[:-6]]
    return spark.createDataFrame([*marks, (None, 1, 0), (3, None, None), (4, 0, 0)], LABELS)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def plain(rows):
    return [(r[0], r[1] or "") for r in rows]


def tokens(path):
    t = Tokenizer.from_file(path)
    return lambda x: np.array(t.encode(x, add_special_tokens=False).ids + [2], "<u4")


def same(a, b):
    return collections.Counter(map(tuple, a)) == collections.Counter(map(tuple, b))


# -- 1 -----------------------------------------------------------------------------------------------------------
URLS = [
    None, "", "no scheme/x", "https://WWW.Example.com/en/1", "https://a.example.com/en/", "https://example.com", "https://example.com/fr?x=/en/", "http://x.net/es/2#a", "http://net/fr/", "https://badnet/es/",
    "https://casino-bonus.example.org/en/12", "https://library.example.org/en/12", "://", "https://É.com/é", "https://h.com/" + "p" * 50_000, "ftp://a://b/c",
]


def test_url_filter(spark):
    pages = spark.createDataFrame([(i, u, "rule", 1.0) for i, u in enumerate(URLS)] + [(None, URLS[3], None, None)], "page_id long, url string, rule string, score double")
    got = {r["page_id"]: r for r in url_filter.filter_urls(pages).collect()}
    weights, intercept = url_filter.fit(url_filter.labelled_urls())
    verdicts = dict(url_filter.RULES)
    for i, u in enumerate(URLS):
        host, path = url_filter.split_url(u)
        fits = [r for r in verdicts for h, _, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        rule = max(fits, key=len, default=None)
        want = verdicts[rule] if rule else "block" if url_filter.log_odds(u, weights, intercept) > 0 else "allow"
        assert tuple(got[i][c] for c in ("host", "path", "rule", "verdict")) == (host, path, rule, want), u
    assert got[3]["rule"] == "www.example.com/en/" and got[4]["verdict"] == "block" and got[10]["verdict"] == "block" and got[11]["verdict"] == "allow"
    assert None in got and url_filter.filter_urls(pages.limit(0)).count() == 0
    mine = spark.createDataFrame([("https://foo.bar/", 1), ("https://baz.qux/", 0)], "url string, block int")
    assert url_filter.filter_urls(pages, labelled=mine).count() == len(URLS) + 1


def test_url_filter_sql(spark, data_dir):
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{data_dir}/pages.parquet'")
    got = url_filter.filter_urls(spark.read.parquet(f"{data_dir}/pages.parquet"))
    assert same(got.collect(), [tuple(r) for r in con.sql(url_filter.filter_sql()).fetchall()])


# -- 2 -----------------------------------------------------------------------------------------------------------
def base_spans(x):
    a = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
    s = [(m.start(), 0, m.end()) for m in a.finditer(x) if len(m[1]) >= 8] + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", x) if len(m[0]) >= 16]
    return sorted(s + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", x) if len(m[0]) >= 32])


def test_secret_scan(spark, docs, nothing, rows):
    rng = random.Random(3)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    key = lambda n: "".join(rng.choice(alphabet) for _ in range(n)) + "9aZ"
    hard = [
        'Password: "hunter2hunter2" é token=secret: abcdefgh1234', "api_key = 'abc' apikey=ABCDEFGH.-_", "AKIAKIAABCDEFGHIJKL AKIA1234567890AB akiaX", "é" * 5 + "0123456789abcdef" * 3,
        f"see {key(40)} and {key(60)}=", "word-joined-by-hyphens-and-2-numbers-in-one-long-name", "a/long/path/of/2/many/parts/that/is/not/random/at/all", "passwd:" + "x" * 100_000, "",
    ]
    frame = docs.unionByName(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(hard)], "doc_id long, text string"), allowMissingColumns=True)
    known = plain(rows) + [(1000 + i, t) for i, t in enumerate(hard)]
    want = []
    for i, x in known:
        s = base_spans(x)
        said = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{z}" for a, k, z in s)
        want.append((i, *[sum(k == j for _, k, _ in s) for j in range(3)], hashlib.sha256(said.encode()).hexdigest()))
    got = secret_scan.secret_report(frame).collect()
    assert same([r[:5] for r in got], want)
    by_id = {r["doc_id"]: r["spans"] for r in got}
    assert by_id[1004].count("random") == 2 and "random" not in by_id[1005] + by_id[1006]
    for r in got:  # base spans stay
        assert hashlib.sha256(",".join(z for z in r["spans"].split(",") if z and not z.startswith("random")).encode()).hexdigest() == r["base_sha256"]
    assert secret_scan.secret_report(nothing).count() == 0


def test_secrets_straight_behind_an_equals_sign(spark):
    lines = [
        "STRIPE_KEY=4eC39HqLyjWDarjtT1zdp7dcQx81", "AWS_SECRET_ACCESS_KEY=wJalrXUtnFEMI/K7MDENG/bPxRfiCYzQ3vN8sTLd", "https://h/?sig=Zk3vQ9xT1mWc7RbLy0HsDf5JgUe2NaPo&x=1", "x == 4eC39HqLyjWDarjtT1zdp7dcQx81",
        "name=a-plain-name-with-hyphens-and-2-numbers-in-it", "4eC39HqLyjWDarjtT1zdp7dcQx81=",
    ]
    got = {r["doc_id"]: r["spans"] for r in secret_scan.secret_report(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(6)] == ["random:11:39", "random:22:62", "random:15:47", "random:5:33", "", "random:0:29"]


def test_false_discovery_cuts():
    even = {(0, b): 10 for b in range(100)}
    assert secret_scan.cuts_of(even)[0] <= 0.02
    mixed = even | {(0, b): 10 + 400 * (b < 3) for b in range(100)}
    assert 0.02 < secret_scan.cuts_of(mixed)[0] < 0.3
    assert secret_scan.cuts_of({(1, 5): 3}) == {}


# -- 3 -----------------------------------------------------------------------------------------------------------
def test_neighbour_quality(docs, labels, nothing, rows, spark):
    got = neighbour_quality.quality_scores(docs, labels).collect()
    assert same([(r["doc_id"],) for r in got], [(r[0],) for r in rows])
    for r in got:
        held = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1
        assert (r["held_out"], 0 <= r["score"] <= 1, r["predicted"]) == (held, True, int(r["score"] >= 0.5))
    assert neighbour_quality.quality_scores(nothing, labels).count() == 0
    none = spark.createDataFrame([], LABELS)
    assert {r["score"] for r in neighbour_quality.quality_scores(docs, none).collect()} == {0.5}
    assert neighbour_quality.keep_good(docs, labels).columns == docs.columns


def test_held_out_labels_are_not_used(docs, labels):
    flipped = labels.withColumn("quality", F.when(neighbour_quality.is_held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    score = lambda x: {(r["doc_id"], r["score"]) for r in neighbour_quality.quality_scores(docs, x).collect()}
    assert score(labels) == score(flipped)


def test_neighbour_quality_is_right_on_held_out_documents(spark):
    d = "/root/testdata/sf0.1"
    if not os.path.isdir(d):
        pytest.skip("no test data here")
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = neighbour_quality.quality_scores(docs, labels).where("held_out").join(labels, "doc_id")
    right = got.groupBy("quality").agg(F.avg((F.col("predicted") == F.col("quality")).cast("double")).alias("a")).collect()
    assert len(right) == 2 and all(r["a"] > 0.95 for r in right)


def test_odd_column_names_pass(spark, docs, labels):
    odd = docs.selectExpr("*", "1 as `my col`", "named_struct('a b', 2, 'c`d', 3) as `x.y`")
    got = neighbour_quality.keep_good(odd, labels)
    assert got.columns == odd.columns and got.first()["x.y"]["a b"] == 2


def test_blocked_votes_are_exact():
    rng = np.random.default_rng(0)
    counts = rng.poisson(0.3, (90, neighbour_quality.TERMS)).astype(np.float32)
    quality = (rng.random(90) > 0.4).astype(float)
    m = neighbour_quality.Model(counts, quality, 0.6, rank=8)
    some = rng.poisson(0.3, (700, neighbour_quality.TERMS)).astype(np.float32)
    v = neighbour_quality.damped(some, m.weights) @ m.basis
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    want = []
    for c in v @ m.vectors.T:
        near = np.argsort(-c, kind="stable")[: neighbour_quality.NEIGHBOURS]
        w = np.maximum(c[near], 1e-6) ** neighbour_quality.POWER
        good, bad = (w @ m.votes[near]).tolist()
        want.append(good / (good + bad))
    assert np.allclose(m.scores(some), want, atol=1e-4)


def test_quality_tasks_get_a_text_once_and_drop_encoders(spark, labels, monkeypatch):
    """Workers still have the words of an earlier packing; rows with their texts pass to Python once."""
    docs = spark.createDataFrame([(i, None if i == 3 else f"{i} " + "some words of it " * 500) for i in range(20)], "doc_id long, Text string")
    seen, plain = [], type(docs).mapInArrow

    def spy(self, f, schema, *a):
        seen.append((self, f))
        return plain(self, f, schema, *a)

    monkeypatch.setattr(type(docs), "mapInArrow", spy)
    kept = neighbour_quality.keep_good(docs, labels).collect()
    monkeypatch.undo()
    want = {r["doc_id"] for r in neighbour_quality.quality_scores(docs, labels).collect() if r["predicted"]}
    assert {r["doc_id"] for r in kept} == want and all((r["Text"] is None) == (r["doc_id"] == 3) for r in kept)
    rows, score = seen[-1]
    table = rows.toArrow().combine_chunks()
    assert table.nbytes < 1.5 * sum(len(r["Text"] or "") for r in docs.collect())
    for _, f in seen:
        monkeypatch.setattr(encoding, "_ENCODERS", {})
        encoding.encoder(BYTES, True).encode(["words that stay"])
        list(f(iter([])))
        assert not encoding._ENCODERS
    assert sum(b.num_rows for b in score(iter(table.to_batches()))) == 20


# -- 4 -----------------------------------------------------------------------------------------------------------
def test_forgotten_words_leave_memory(monkeypatch):
    def held():
        with open("/proc/self/smaps_rollup") as f:
            return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", f.read()))) / 1024

    monkeypatch.setattr(encoding, "_ENCODERS", {})
    rng = random.Random(3)
    some = [" ".join("".join(rng.choices("abcdefghijklmnop", k=9)) for _ in range(1000)) for _ in range(300)]
    before = held()
    ids = [encoding.encoder(BYTES, True).encode_bytes([x])[0] for x in some]
    full = held()
    encoding.forget()
    assert held() - before < 0.5 * (full - before)
    assert encoding.encoder(BYTES, True).encode_bytes(some[:5]) == ids[:5]
    encoding.forget()


def test_packing_takes_few_texts_at_once(spark, docs, monkeypatch):
    key, seen, plain = "spark.sql.execution.arrow.maxRecordsPerBatch", [], packing.stored
    monkeypatch.setattr(packing, "stored", lambda *a: (seen.append(int(spark.conf.get(key))), plain(*a))[1])
    before = spark.conf.get(key)
    packing.pack_documents(docs, BYTES)
    assert seen == [packing.BATCH_ROWS] and packing.ROWS <= packing.BATCH_ROWS <= 1024 and spark.conf.get(key) == before


def test_packing(docs, nothing, rows):
    encode, want = tokens(BYTES), []
    for i, x in plain(rows):
        ids = encode(x)
        n, start, piece = len(ids), 0, 0
        end = (n - 1) % 1024 + 1
        while start < n:
            want.append((i, piece, start, end - start, zlib.crc32(ids[start:end].tobytes())))
            start, end, piece = end, end + 1024, piece + 1
    got = packing.pack_documents(docs, BYTES).collect()
    assert same([r[:5] for r in got], want)
    by = collections.defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        places.sort()
        assert [o for o, _ in places] == [0, *np.cumsum([n for _, n in places])[:-1]] and sum(n for _, n in places) <= 1024
    assert len(by) <= 1.03 * sum(r[3] for r in want) / 1024 + 2
    assert packing.pack_documents(nothing, BYTES).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plans_place_every_piece(seed):
    rng = random.Random(seed)
    lengths = [min(64, max(1, int(rng.lognormvariate(2.5, 1)))) for _ in range(rng.choice([1, 7, 300, 3000]))]
    histogram = collections.Counter(lengths)
    plan = packing.plan_packing(histogram, 64, groups=32)
    bins, ends = collections.defaultdict(list), collections.defaultdict(list)
    for s, low, seq, off in zip(plan.length, plan.low, plan.sequence, plan.offset):
        ends[s].append((low, seq, off))
    for s, n in histogram.items():
        intervals = sorted(ends[s])
        for (low, seq, off), high in zip(intervals, [x[0] for x in intervals[1:]] + [n]):
            for k in range(low, high):
                bins[seq + k - low].append((off, s))
    assert sum(map(len, bins.values())) == len(lengths) and len(bins) == plan.n_sequences
    for b in bins.values():
        at = 0
        for off, s in sorted(b):
            assert off == at
            at += s
        assert at <= 64
    assert plan.n_sequences <= 1.1 * sum(lengths) / 64 + 3


# -- 5 -----------------------------------------------------------------------------------------------------------
def test_line_rules(docs, nothing, rows):
    want = []
    for i, x in plain(rows):
        w = WORD.findall(x)
        often = collections.Counter(zip(w, w[1:], w[2:]))
        again = {k + j for k in range(len(w) - 2) if often[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [y for y in x.split("\n") if WORD.search(y)]
        failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), len(lines) - len(set(lines)), len(again), failed))
    got = line_rules.line_quality(docs).collect()
    assert same([r[:7] for r in got], want)
    assert all(not (r["kept"] and r["base_failed"]) for r in got) and any(r["kept"] for r in got)
    assert line_rules.line_quality(nothing).count() == 0


def test_viterbi_is_the_best_path():
    rng = random.Random(5)
    for n in (1, 2, 7):
        u = [[rng.uniform(-2, 2) for _ in range(2)] for _ in range(n)]
        t = [[rng.uniform(-1, 1) for _ in range(2)] for _ in range(2)]
        score = lambda y, u=u, t=t: sum(u[i][c] for i, c in enumerate(y)) + sum(t[a][b] for a, b in zip(y, y[1:]))
        best = max(([int(b) for b in f"{k:0{n}b}"] for k in range(2**n)), key=score)
        assert line_rules.viterbi(u, t) == best


def test_field_labels_its_table_and_gradient():
    table = line_rules.labelled_lines()
    w, t = line_rules.fit_field(table)
    right = total = 0
    for lines, y in table:
        x = line_rules.Batch(["\n".join(lines).encode()]).features
        right += sum(a == b for a, b in zip(line_rules.viterbi((x @ w).tolist(), t.tolist()), y))
        total += len(y)
    assert right / total > 0.97


# -- 6 -----------------------------------------------------------------------------------------------------------
def keepers(rows):
    groups = collections.defaultdict(list)
    for i, x in rows:
        groups[SPACE.sub("", x)].append((-len(x), i is None, i or 0, i))
    return {k: (min(v)[3], len(v)) for k, v in groups.items()}


@pytest.mark.parametrize("bits", [1 << 26, 64])
def test_exact_dedup(docs, nothing, rows, bits):
    best = keepers(plain(rows))
    got = exact_dedup.duplicate_report(docs, bits).collect()
    want = [(i, *best[SPACE.sub("", x)], hashlib.sha256(SPACE.sub("", x).encode()).hexdigest()) for i, x in plain(rows)]
    assert same([(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got], want)
    kept = collections.Counter(r["text_sha256"] for r in got if r["kept"])
    assert set(kept.values()) == {1} and len(kept) == len(best)
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
    left = exact_dedup.deduplicate(docs, bits)
    assert left.columns == docs.columns and same([(r["doc_id"],) for r in left.collect()], [(k,) for k, _ in best.values()])
    assert exact_dedup.duplicate_report(nothing, bits).count() == 0 and exact_dedup.deduplicate(nothing).count() == 0


def test_exact_dedup_sql(spark, data_dir):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{data_dir}/documents.parquet'")
    got = exact_dedup.duplicate_report(spark.read.parquet(f"{data_dir}/documents.parquet"))
    assert same(got.collect(), con.sql(exact_dedup.DUPLICATE_SQL).fetchall())


# -- 7 -----------------------------------------------------------------------------------------------------------
def shingles(x):
    w = WORD.findall(x)
    return frozenset(zip(*[w[k:] for k in range(5)])) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()


def similar(rows):
    sets = [shingles(x) for _, x in rows]
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 5 * common >= 4 * (len(sets[a]) + len(sets[b]) - common):
                links[a] += 1
                links[b] += 1
                root[max(find(a), find(b))] = min(find(a), find(b))
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    least = lambda g: min((rows[i][0] for i in g if rows[i][0] is not None), default=None)
    return [(rows[i][0], least(groups[find(i)]), len(groups[find(i)]), links[i]) for i in range(len(rows))]


def test_chosen_path(docs, nothing, rows):
    got = chosen_path.similar_groups(docs).collect()
    assert same([(r["doc_id"], r["class_id"], r["group_size"], r["n_links"]) for r in got], similar(plain(rows)))
    left = chosen_path.one_of_each(docs)
    # Rows that are equal in doc_id and text (two more of 7 here) stay together.
    assert left.columns == docs.columns and left.count() == sum(r["kept"] for r in got) + sum(r[0] == 7 and r[1] == rows[7][1] for r in rows) - 1
    assert chosen_path.similar_groups(nothing).count() == 0 and chosen_path.one_of_each(nothing).count() == 0


def test_chosen_path_in_blocks(spark, monkeypatch):
    """A group much larger than a bucket, all near copies of one text, beside smaller ones."""
    monkeypatch.setattr(chosen_path, "LIMIT", 8)
    monkeypatch.setattr(chosen_path, "COUNT_BLOCK", 16)
    rng = random.Random(9)
    out = []
    for g, size in enumerate((60, 3, 2, 1)):
        base = sentence(rng, 150).split(" ")
        for _ in range(size):
            w = list(base)
            w[rng.randrange(150)] = f"w{rng.randrange(10**6)}"
            out.append((len(out), " ".join(w)))
    got = chosen_path.similar_groups(spark.createDataFrame(out, "doc_id long, text string")).collect()
    assert same([(r["doc_id"], r["class_id"], r["group_size"], r["n_links"]) for r in got], similar(out))


def test_chosen_path_keeps_every_runs_path_of_a_large_bucket(spark, monkeypatch):
    """Families of almost equal texts, each larger than a bucket, with one text at about the threshold to all of them."""
    monkeypatch.setattr(chosen_path, "LIMIT", 8)
    rng = random.Random(5)
    out = []
    for _ in range(16):
        base = [f"w{rng.randrange(10**6)}" for _ in range(900)]
        for i in range(12):
            out.append((len(out), " ".join([*base[:400], f"x{i}", *base[401:]])))
        out.append((len(out), " ".join(base[:810] + [f"y{rng.randrange(10**6)}" for _ in range(90)])))
    got = chosen_path.similar_groups(spark.createDataFrame(out, "doc_id long, text string")).collect()
    assert same([(r["doc_id"], r["class_id"], r["group_size"], r["n_links"]) for r in got], similar(out))
    assert {r["group_size"] for r in got} == {13}


def test_prefixes_lose_no_pair():
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 32, 100, dtype=np.uint64).astype(np.uint32)
    sets = []
    for i in range(120):
        x = base.copy()
        at = rng.choice(100, rng.integers(0, 16), replace=False)
        x[at] = rng.integers(0, 1 << 32, len(at), dtype=np.uint64).astype(np.uint32)
        sets.append(np.unique(x[: rng.integers(1, 101)] if i % 3 == 0 else x))
    for common in (np.zeros(0, np.uint32), base[:50], rng.permutation(base)):
        cut = [set(chosen_path.prefix(x, common).tolist()) for x in sets]
        for i, j in np.argwhere(np.triu(chosen_path.linked_pairs(sets), 1)):
            assert cut[i] & cut[j]


def test_prefix_lists_tell_their_main_component(spark):
    """The lists come with what ``_with_main`` counts of them, by one join over their members."""
    rng = np.random.default_rng(4)
    common = rng.integers(0, 1 << 32, 60, dtype=np.uint64).astype(np.uint32)
    sets = [np.unique(np.concatenate([rng.choice(common, 40, replace=False), rng.integers(0, 1 << 32, 8, dtype=np.uint64).astype(np.uint32)])) for _ in range(90)]
    rows = spark.createDataFrame([(i % 2, i, i // 3, 3, 42) for i in range(90)], "path long, cls long, root long, m long, o long")
    lists = chosen_path._prefix_lists(rows, spark.createDataFrame([(i, x.tobytes()) for i, x in enumerate(sets)], "cls long, sh binary"))
    told = lists._jdf.queryExecution().optimizedPlan().toString()
    got = [tuple(r) for r in lists.select("path", "cls", "root", "main", "m", "o").collect()]
    want = [tuple(r) for r in chosen_path._with_main(lists.select("path", "cls", "root")).collect()]
    assert got and same(got, want) and told.count("Join Inner") == 1


def test_a_template_stays_in_small_cells(spark, monkeypatch):
    """Many texts of one template at a similarity of about 0.64, and two linked pairs and a linked outlier among them."""
    rng = random.Random(21)
    template = [sentence(rng, 1) + str(i) for i in range(240)]
    known = []
    for i in range(700):
        w = list(template)
        for k in range(0, 240, 24):  # each change touches five shingles
            w[k + (i % 3)] = f"own{i}x{k}"
        known.append((i, " ".join(w)))
    known += [(1000, known[5][1].replace("own5x0", "other")), (1001, known[9][1] + " two more")]
    frame = spark.createDataFrame(known, "doc_id long, text string").repartition(4)
    sizes = []
    plain_edges = chosen_path._edges

    def edges(blocks, sets):
        blocks = chosen_path.stored(blocks, "blocks")
        n = blocks.groupBy("path", "block").count().agg(F.max("count"), F.sum("count")).first()
        sizes.append(tuple(n))
        return plain_edges(blocks, sets)

    monkeypatch.setattr(chosen_path, "_edges", edges)
    monkeypatch.setattr(chosen_path, "DENSE", chosen_path.LIMIT)
    got = {r["doc_id"]: (r["class_id"], r["group_size"], r["n_links"]) for r in chosen_path.similar_groups(frame).collect()}
    want = similar([(i, x) for i, x in known])
    assert got == {w[0]: w[1:] for w in want}
    assert max(m or 0 for m, _ in sizes) <= 2.5 * chosen_path.LIMIT and sum(t or 0 for _, t in sizes) < 60 * len(known)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150), (7, 300)]
    got = {r["v"]: r["root"] for r in chosen_path.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 300: 0, 100: 100, 150: 100, 200: 100}
    assert chosen_path.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_recall_needs_more_runs_for_deeper_splits():
    assert chosen_path.n_runs(0.8, 0.9999, 1) < chosen_path.n_runs(0.8, 0.9999, 4)


# -- 8 -----------------------------------------------------------------------------------------------------------
def test_token_files(docs, nothing, rows):
    encode = tokens(WORDS)
    known = sorted(plain(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    got = token_files.token_file_report(docs, WORDS).collect()
    assert same([(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got], [(i, len(encode(x)), zlib.crc32(encode(x).tobytes())) for i, x in known])
    ordered = sorted(got, key=lambda r: r["start"])
    assert [r["doc_id"] for r in ordered] == [i for i, _ in known]
    assert [r["start"] for r in ordered] == [0, *np.cumsum([r["n_tokens"] for r in ordered])[:-1].tolist()]
    assert token_files.token_file_report(nothing, WORDS).count() == 0


@pytest.mark.parametrize("values", [[], [0], [5], [0, 0, 0], list(range(1000)), [3, 3, 10**12, 10**12 + 1], sorted(random.Random(2).choices(range(10**9), k=700))])
def test_elias_fano(values):
    e = token_files.EliasFano.from_bytes(memoryview(token_files.EliasFano.of(np.array(values, np.int64)).to_bytes()))
    assert e.all().tolist() == values and [e.select(i) for i in range(len(values))] == values
    if len(values) == 700:
        assert len(e.to_bytes()) * 8 < 700 * (2 + np.log2(10**9 / 700) + 2) + 200


def test_segment_gives_any_document():
    ids = [np.array(x, "<u2") for x in ([1, 2], [2], [5, 6, 7, 2])]
    raw = token_files.pack_segment(0, 0, [None, 4, 9], ids, 2) + b"\n"
    (s,) = token_files.segments(raw * 1)
    assert s.doc_ids() == [None, 4, 9] and [s.tokens(i).tolist() for i in range(3)] == [x.tolist() for x in ids]
    assert len(list(token_files.segments(raw * 3))) == 3


ODD = [
    "a  b", "Don't. I'm, 'tis x's y.' z", "a\nb", "a\n\nb", "a \nb", "\n", "", " ", "a\tb\x01 c", "é à͂ ñ̃ o ́x", "12,3 4. ½. x².", "İstanbul ΑΣ. Σ", "a\u00a0b c\u200bd\u3000x", "x.\ny|\n|z!", "!! ,. .",
    "a'll. b's's", "\x01 \x01 a\x01 b", "Été ßÜ ÿ µ", "! a! !b", "A\n!\nB", "ſ Ā", "a.\n\n.b\n,", "<|endoftext|> <|startoftext|>", "a\t\n\tb", "a\x1cb", "\ud83d\ude00".encode("utf-16", "surrogatepass").decode("utf-16") + " 😀.", "ab. " * 500,
]


@pytest.mark.parametrize("path, spaces", [(BYTES, True), (WORDS, False)])
def test_words_encode_as_whole_texts_do(path, spaces):
    e, library = WordEncoder(path, spaces, entries=50), Tokenizer.from_file(path)
    added = [t.content for t in library.get_added_tokens_decoder().values()]
    every = ODD + texts() + [x for t in added for x in (f"a{t} b", f"{t.upper()} {t}{t}.", t, f" {t}\n")]
    for a in range(0, len(every), 9):
        some = every[a : a + 9]
        assert [x.tolist() for x in e.encode(some)] == [library.encode(x, add_special_tokens=False).ids for x in some]


@pytest.mark.parametrize("path, spaces", [(BYTES, True), (WORDS, False)])
def test_ids_of_random_texts_are_the_librarys(path, spaces):
    e, library, rng = WordEncoder(path, spaces, entries=3000), Tokenizer.from_file(path), random.Random(5)
    added = [t.content for t in library.get_added_tokens_decoder().values()]
    odd = [*" \n\t.,!'\"-|<>ßİıΣςéÉàñµªº½²Kſ", "\u0301", "\u0307", "\u0338", "\u0958", "\u212b", "\u1e9e", "\ufb01", "日", "한", "\u1100\u1161", "😀", "\u200d", "\u00a0", "\u3000", "'s", "'LL", *added, *[x.upper() for x in added], *[x[:-1] for x in added]]
    for _ in range(200):
        some = []
        for _ in range(20):
            parts = [rng.choice(odd) if rng.random() < 0.35 else chr(rng.randrange(32, 0x250)) if rng.random() < 0.1 else chr(rng.randrange(0x250, 0x3000)) if rng.random() < 0.05 else rng.choice(["ta", "Ri", "no ", "7", " ", "the"]) for _ in range(rng.randint(0, 30))]
            some.append("".join(parts))
        assert [x.tolist() for x in e.encode(some)] == [library.encode(x, add_special_tokens=False).ids for x in some]


def test_few_words_are_translated(monkeypatch):
    """Words beyond ASCII are written by bytes in texts of their own; ids are the library's."""
    rng = random.Random(12)
    plain = ["".join(rng.choice("abcdefghijklmnop") for _ in range(9)) for _ in range(5000)]
    words = [w + "é" if i % 10 == 0 else w for i, w in enumerate(plain)]
    seen = []

    class Chars(dict):
        def __getitem__(self, k):
            seen.append(k)
            return super().__getitem__(k)

    monkeypatch.setattr(encoding, "BYTE_CHARS", Chars(encoding.BYTE_CHARS))
    got = WordEncoder(WORDS, False).encode([" ".join(words)])[0].tolist()
    assert got == Tokenizer.from_file(WORDS).encode(" ".join(words), add_special_tokens=False).ids
    assert len(seen) < sum(map(len, words)) / 3


def test_token_files_refuse_a_width_that_ids_do_not_fit(docs, spark):
    with pytest.raises(ValueError, match="fit"):
        token_files.write_token_files(docs, "/nonexistent", WORDS, False, width=1)


def test_a_file_holds_one_segment(spark, tmp_path):
    docs = spark.createDataFrame([(i, "some words that make a few ids " * 3) for i in range(40)], "doc_id long, text string").coalesce(1)
    token_files.write_token_files(docs, str(tmp_path / "t"), WORDS, False, segment_ids=50)
    files = [p for p in (tmp_path / "t").glob("part-*")]
    assert len(files) > 3 and all(len(list(token_files.segments(p.read_bytes()))) == 1 for p in files)
    got = sorted(map(tuple, token_files.read_token_files(spark, str(tmp_path / "t")).collect()))
    assert [g[0] for g in got] == list(range(40)) and [g[1] for g in got] == [i * got[0][2] for i in range(40)]


# -- 9 -----------------------------------------------------------------------------------------------------------
def test_rates_against_a_plain_projected_gradient(spark):
    """Against the same steps over all documents at once; the gap that is left is told, and warned of where it is not small."""
    rng = np.random.default_rng(5)
    p = rng.dirichlet([0.4] * 3, 80)
    tokens = rng.integers(0, 400, 80)
    digest = spark.createDataFrame([(int(n), x.tolist()) for n, x in zip(tokens, p)], "tokens long, p array<double>")
    have = tokens @ p
    for weights, low in (({"a": 0.5, "b": 0.3, "c": 0.2}, 0.0), (None, None), ({"a": 1.0}, 0.5)):  # the last cannot be met
        with warnings.catch_warnings(record=True) as said:
            warnings.simplefilter("always")
            mix = mixing.fit_mixture(digest, ["a", "b", "c"], weights, low)
        rates = np.array([r[0] for r in digest.select(mixing.rate_of(F.col("p"), mix.steps, mix.low)).collect()])
        share = np.array([weights.get(d, 0.0) for d in "abc"]) if weights else (have / have.sum()) ** mixing.TEMPER
        share = share / share.sum()
        size = have.sum() if low is not None else (have / share).max()
        assert np.allclose(mix.targets, share * size)
        plain, least = np.ones(80), 1.0 if low is None else low
        for _ in range(len(mix.steps)):
            plain = np.maximum(least, plain - p @ (((plain * tokens) @ p - share * size) / have))
        assert np.allclose(rates, plain, rtol=1e-6, atol=1e-6)
        assert abs(mix.error - np.abs((plain * tokens) @ p - share * size).max() / size) < 1e-6
        assert bool([w for w in said if "off its target" in str(w.message)]) == (mix.error > mixing.TOLERANCE)
    assert mix.error > 0.01


def test_mixing(spark, docs, nothing, rows):
    labelled = docs.selectExpr("text", "lang as domain")
    got = mixing.mixture_rates(docs, labelled)
    assert got.count() == len(rows)
    p = [c for c in got.columns if c.startswith("p_")]
    assert p == ["p_de", "p_en", "p_fr"]
    for r in got.collect():
        assert abs(sum(r[c] for c in p) - 1) < 1e-9 and r["rate"] >= 1 and r["copies"] in (int(r["rate"]), int(r["rate"]) + 1)
    assert mixing.mixture_rates(nothing, labelled).count() == 0 and mixing.mixture_rates(docs, nothing.selectExpr("text", "lang as domain")).agg(F.sum("copies")).first()[0] == len(rows)
    out = mixing.mix_documents(docs, labelled)
    assert out.columns == docs.columns and out.count() == got.agg(F.sum("copies")).first()[0]
    assert mixing.mix_documents(nothing, labelled).count() == 0


def test_more_domains_than_the_bound_are_an_error(spark):
    rows = [(f"text {i}", f"d{i}") for i in range(mixing.MAX_DOMAINS + 1)]
    with pytest.raises(ValueError, match="domains"):
        mixing.fit_classifier(spark.createDataFrame(rows, "text string, domain string"))


def test_rates_meet_the_targets(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    weights = {"en": 0.4, "fr": 0.3, "de": 0.2, "es": 0.1}
    got = mixing.mixture_rates(docs, docs.selectExpr("text", "lang as domain"), weights, low=0.0)
    right = got.join(docs.select("doc_id", "lang"), "doc_id").agg(F.avg((F.col("domain") == F.col("lang")).cast("double"))).first()[0]
    sums = got.agg(*[F.sum(F.col("rate") * F.col("tokens") * F.col(f"p_{d}")).alias(d) for d in weights], F.sum("tokens").alias("all")).first()
    assert right > 0.9 and all(abs(sums[d] / sums["all"] - w) < 0.01 for d, w in weights.items())


# -- 10 ----------------------------------------------------------------------------------------------------------
def removed(rows, length=50):
    first = {}
    key = lambda i: (i is None, i or 0)
    for i, x in rows:
        b = x.encode()
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            first[s] = min(first.get(s, key(i)), key(i))
    out = []
    for i, x in rows:
        b = x.encode()
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < key(i):
                gone[p : p + length] = True
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("chunk, ranges, hot", [(1 << 20, 1 << 22, 64), (3000, 4000, 64), (3000, 4000, 2)])
def test_suffix_dedup(docs, nothing, rows, chunk, ranges, hot):
    got = suffix_dedup.remove_repeats(docs, chunk_bytes=chunk, range_bytes=ranges, hot=hot).drop("spans").collect()
    assert same(got, removed(plain(rows)))
    assert sum(r["n_removed"] for r in got) > 1000
    assert suffix_dedup.remove_repeats(nothing).count() == 0


def test_suffix_dedup_of_long_periodic_texts(spark):
    """Runs of more than 65,535 windows with one leading token, and runs sent behind them."""
    rng = random.Random(12)
    shared = sentence(rng, 60)
    known = [(i, "free " * n + sentence(rng, 40) + shared + sentence(rng, 40)) for i, n in enumerate((14_000, 13_500, 0, 40))] + [(9, "=" * 70_000)]
    known.append((10, "=" * 200 + sentence(rng, 40)))
    got = suffix_dedup.remove_repeats(spark.createDataFrame(known, "doc_id long, text string")).drop("spans").collect()
    assert same(got, removed(known))


def test_suffix_dedup_of_equal_bytes(spark):
    """Two documents of 70,000 equal bytes, blocks of positions that end within them, and a passage behind."""
    passage = "".join(chr(97 + (i * i * 7 + i) % 26) for i in range(400))
    known = [(1, "-" * 70_000 + passage), (2, "-" * 70_000), (3, passage), (4, "=" * 300_000)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(known, "doc_id long, text string"), chunk_bytes=1000, range_bytes=100_000, hot=3).drop("spans").collect()
    assert same(got, removed(known))
    assert {r["doc_id"]: r["n_removed"] for r in got} == {1: 0, 2: 70_000, 3: 400, 4: 0}


def test_least_ids_in_blocks(monkeypatch):
    rng = random.Random(3)
    parts = [sentence(rng, 12).encode() for _ in range(6)]
    texts = list({b"".join(rng.choices(parts, k=2))[:120] for _ in range(60)})
    texts = [t for t in texts if len(t) >= 50]
    counts, ids = np.array([len(t) - 49 for t in texts]), np.array([rng.randrange(30) for _ in texts])
    want: dict[bytes, int] = {}
    for t, i in zip(texts, ids.tolist()):
        for k in range(len(t) - 49):
            want[t[k : k + 50]] = min(want.get(t[k : k + 50], i), i)
    # Texts are runs of one leading token here: each is cut so that its windows share one.
    runs = suffix_dedup.Runs(ids, texts, 50)
    pieces = [(texts[d][s - runs.at[d] : s - runs.at[d] + c + 49], int(ids[d])) for d, s, c in zip(runs.doc.tolist(), runs.start.tolist(), runs.count.tolist())]
    for block in (1, 40, 1 << 17):
        monkeypatch.setattr(suffix_dedup, "BLOCK", block)
        got = suffix_dedup.least_ids([p for p, _ in pieces], np.array([len(p) - 49 for p, _ in pieces]), np.array([i for _, i in pieces]), 50)
        assert got.tolist() == [want[p[k : k + 50]] for p, _ in pieces for k in range(len(p) - 49)]


def test_ids_of_a_message_are_short():
    top, low = np.iinfo(np.int64).max, np.iinfo(np.int64).min
    for ids, size in (([7], 9), ([-3, 4, 200], 11), ([10**12, 10**12 + 60_000], 12), ([5, 1 << 20], 16), ([low, 0, top], 32)):
        raw = suffix_dedup.packed_ids(np.array(ids, np.int64))
        assert len(raw) == size and suffix_dedup.unpacked_ids(raw, len(ids)).tolist() == ids


def test_answered_messages_leave_the_disk(spark):
    """Shuffle files of the messages go while the operator runs, not when the driver happens to collect its garbage."""
    import gc
    import time

    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def held():
        files = [f for f in blocks.getAllFiles().mkString("|").split("|") if f.endswith(".data") and os.path.exists(f)]
        return sum(os.path.getsize(f) for f in files)

    rng = random.Random(3)
    passages = [sentence(rng, 40) for _ in range(60)]
    frame = spark.createDataFrame([(i, " ".join(rng.choices(passages, k=20))) for i in range(400)], "doc_id long, text string")
    gc.collect()
    spark._jvm.System.gc()
    time.sleep(3)
    before = held()
    suffix_dedup.remove_repeats(frame, chunk_bytes=20_000, range_bytes=50_000)
    time.sleep(3)
    assert held() - before < 500_000


def test_runs_are_sent_in_passes(spark, monkeypatch):
    """Where runs are longer than the corpus they go in passes: the disk never holds all messages, and what is removed stays the same."""
    import time

    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def held():
        files = [f for f in blocks.getAllFiles().mkString("|").split("|") if f.endswith(".data") and os.path.exists(f)]
        return {f: os.path.getsize(f) for f in files}

    written, store = [], suffix_dedup.stored

    def watched(df, name, *rest):
        if name != "windows":
            return store(df, name, *rest)
        time.sleep(3)  # files go in the background
        before = held()
        out = store(df, name, *rest)
        after = held()
        written.append((sum(after.values()), sum(n for f, n in after.items() if f not in before)))
        return out

    monkeypatch.setattr(suffix_dedup, "stored", watched)
    rng = random.Random(3)
    passages = [sentence(rng, 40) for _ in range(60)]
    known = [(i, " ".join(rng.choices(passages, k=20))) for i in range(100)]
    frame = spark.createDataFrame(known, "doc_id long, text string")
    base = sum(held().values())
    got = suffix_dedup.remove_repeats(frame, chunk_bytes=20_000, range_bytes=50_000).drop("spans").collect()
    assert max(x for x, _ in written) - base < 0.7 * sum(x for _, x in written)
    assert same(got, removed(known))


@pytest.mark.parametrize("hot", [64, 2])
def test_suffix_dedup_in_many_passes(docs, rows, hot):
    got = suffix_dedup.remove_repeats(docs, chunk_bytes=3000, range_bytes=8000, hot=hot, pass_share=0.2).drop("spans").collect()
    assert same(got, removed(plain(rows)))


def test_suffix_dedup_never_shuffles_texts(spark, docs, rows, monkeypatch):
    """Answers that are too many for one broadcast go to one part of the chunks after another; chunks are not sorted or shuffled to them."""
    plans, store = [], suffix_dedup.stored

    def watched(df, name, *rest):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return store(df, name, *rest)

    monkeypatch.setattr(suffix_dedup, "stored", watched)
    monkeypatch.setattr(suffix_dedup, "BROADCAST_BYTES", 1000)
    monkeypatch.setattr(suffix_dedup, "WEIGHED", 10_000)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = suffix_dedup.remove_repeats(docs, chunk_bytes=3000, range_bytes=8000).drop("spans").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert same(got, removed(plain(rows)))
    assert not [name for name, plan in plans if "SortMergeJoin" in plan or "ShuffledHashJoin" in plan]
    assert sum(name == "marked" for name, _ in plans) > 1


def test_multikey_order():
    rng = np.random.default_rng(4)
    data = np.frombuffer(bytes(rng.integers(97, 99, 400, dtype=np.uint8)) * 2 + bytes(8), np.uint8)
    at = np.arange(0, 740)
    order, new = suffix_dedup.multikey_order(data, at, 50)
    got = [data[at[i] : at[i] + 50].tobytes() for i in order]
    assert got == sorted(got) and new.tolist() == [i == 0 or got[i] != got[i - 1] for i in range(len(got))]


# -- pipeline ----------------------------------------------------------------------------------------------------
def test_pipeline(spark, docs, labels, nothing, rows, tmp_path):
    import corpus_pipeline

    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    scores = {r["doc_id"]: r["score"] for r in neighbour_quality.quality_scores(docs, labels).collect()}
    step = docs
    for name, stage in corpus_pipeline.STAGES:
        before = [(r["doc_id"], r["text"] or "") for r in step.collect()]
        step = stage(spark, step, str(tmp_path))
        assert stage(spark, nothing, str(tmp_path)).count() == 0
        if name == "pack":
            continue
        assert step.columns == docs.columns
        after = [(r["doc_id"], r["text"] or "") for r in step.collect()]
        if name == "quality":
            assert {i for i, _ in after} == {i for i, _ in before if scores[i] >= 0.5 or i in (7, None)} and len(after) < len(before)
        if name == "exact_dedup":
            assert same([(i,) for i, _ in after], [(k,) for k, _ in keepers(before).values()])
        if name == "near_dedup":
            groups = similar(before)
            assert same([(i,) for i, _ in after], [(i,) for i, c, _, _ in groups if i == c])
        if name == "mix":
            assert set(after) == set(before) and len(after) >= len(before)
    encode = tokens(BYTES)
    assert step.agg(F.sum("length")).first()[0] == sum(len(encode(x)) for _, x in after)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == step.count()


def test_the_library_does_without(tmp_path):
    """Without this package and the pipeline the entry point still imports and has the other queries."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[2]
    shutil.copytree(root / "chronofold", tmp_path / "chronofold", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'hotspots' in q and not any(k.startswith('op') for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
