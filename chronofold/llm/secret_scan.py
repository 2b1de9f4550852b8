"""Secret scans: fixed patterns, and a battery of randomness tests with length-aware false-discovery control.

All in SQL expressions over the row: no shuffle of texts, no Python on the executors. Candidates are runs of 20 or
more characters of the base64 alphabets with a digit and a letter. For each, an encoding is inferred (hex,
lower-case or upper-case alphanumeric, base64) and three tests ask whether it could be drawn evenly from it:

* chi-squared: counts of characters against an even alphabet, and counts of character classes against their shares;
* runs: the number of runs above and below the alphabet's middle;
* serial correlation of neighbouring characters at lag one.

The p-values are combined by Fisher's method. Random tokens have even p-values, other tokens have small ones, so in
each stratum (encoding and length class, as short tokens tell less) the number of random tokens is twice that of p
above 1/2 (at most all), and among tokens with p >= t the expected share of others is 1 - random * (1 - t) / passed(t).
The least t that keeps this share within ``false_share`` is the stratum's cut; strata with fewer than ``least``
tokens use the strictest general cut. One pass over the texts makes the histogram (at most 40 strata x 100 bins reach
the driver), a second pass takes the spans.

Nulls: a missing text is the empty one; a missing doc_id stays missing. Equal rows are scanned alike, empty tables
give no rows, other columns are ignored. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.llm.shared import text_of

ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?([A-Za-z0-9+/_.=-]+)"
#: A whole run of the class counts, so the least length can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{12,}+"
HEX = r"[0-9a-f]{32,}+"
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}+(?![A-Za-z0-9+/_=-])"
KINDS = ("assign", "access", "hex", "random")
FALSE_SHARE = 0.05
BINS = 100
LEAST = 20
#: Cut where a stratum has too few tokens to estimate one.
DEFAULT_CUT = 0.05
#: Length classes of an encoding.
CLASSES = 10

SPAN = "array<struct<start:bigint,kind:int,`end`:bigint>>"
#: Alphabets by encoding: hex, lower, upper, base64. A character's place is its value.
ALPHABETS = ("0123456789abcdef", "0123456789abcdefghijklmnopqrstuvwxyz", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")


def _found(pattern: str, group: int = 0) -> str:
    """SQL for the matches of a pattern in t, in order, as array<struct<start, end, g>>; g is the group's text.

    The pieces between the matches and the matches themselves give the offsets. Texts without a match cost one search.
    """
    zipped = f"arrays_zip(split(t, r'{pattern}', -1), regexp_extract_all(t, r'{pattern}', 0), regexp_extract_all(t, r'{pattern}', {group}))"
    return f"""case when t rlike r'{pattern}' then aggregate(filter({zipped}, z -> z.`1` is not null),
        named_struct('at', 0L, 'out', cast(array() as array<struct<start:bigint,`end`:bigint,g:string>>)),
        (s, z) -> named_struct('at', s.at + length(z.`0`) + length(z.`1`), 'out', array_append(s.out,
            named_struct('start', s.at + length(z.`0`), 'end', s.at + length(z.`0`) + length(z.`1`), 'g', z.`2`))),
        s -> s.out) else cast(array() as array<struct<start:bigint,`end`:bigint,g:string>>) end"""


def _spans(found: str, kind: int, keep: str = "true") -> str:
    """SQL for spans of a kind from found matches z."""
    return f"transform(filter({found}, z -> {keep}), z -> named_struct('start', z.start, 'kind', {kind}, 'end', z.`end`))"


def base_spans() -> str:
    """SQL for the spans of the fixed patterns in t."""
    assign = _spans(_found(ASSIGN, 1), 0, "length(z.g) >= 8")
    return f"concat({assign}, {_spans(_found(ACCESS), 1)}, {_spans(_found(HEX), 2)})"


def _tail(z: str) -> str:
    """SQL for the normal distribution's upper tail (logistic form, error below 2e-4)."""
    return f"(1D / (1D + exp(greatest(-700D, least(700D, 1.5976D * ({z}) + 0.07056D * pow({z}, 3D))))))"


def _chi_tail(x: str, k: str) -> str:
    """SQL for chi-squared's upper tail with k degrees of freedom (Wilson-Hilferty)."""
    return _tail(f"(pow(greatest(0D, {x}) / ({k}), 1D / 3D) - (1D - 2D / (9D * ({k})))) / sqrt(2D / (9D * ({k})))")


def tested_tokens() -> str:
    """SQL for the candidates of t with their tests: array<struct<start, end, enc, n, p>>."""
    code = "case when z.g rlike r'^([0-9a-f]+|[0-9A-F]+)$' then 0 when z.g rlike r'^[0-9a-z]+$' then 1 when z.g rlike r'^[0-9A-Z]+$' then 2 else 3 end"
    mixed = f"filter({_found(CANDIDATE)}, z -> z.g rlike r'[0-9]' and z.g rlike r'[A-Za-z]')"
    coded = f"transform({mixed}, z -> named_struct('start', z.start, 'end', z.`end`, 'enc', {code}, 'g', translate(z.g, '-_=', '+/')))"
    tables = "array(" + ", ".join(f"'{a}'" for a in ALPHABETS) + ")"
    values = f"transform(split(case when c.enc = 0 then lower(c.g) else c.g end, ''), ch -> instr(element_at({tables}, c.enc + 1), ch) - 1)"
    valued = f"transform({coded}, c -> named_struct('start', c.start, 'end', c.`end`, 'enc', c.enc, 'k', element_at(array(16D, 36D, 36D, 64D), c.enc + 1), 'v', {values}, 'digits', length(regexp_replace(c.g, '[^0-9]', '')), 'low', length(regexp_replace(c.g, '[^a-z]', '')), 'up', length(regexp_replace(c.g, '[^A-Z]', ''))))"
    n = "size(e.v)"
    squares = "aggregate(sequence(0, cast(e.k as int) - 1), 0D, (s, j) -> s + pow(size(filter(e.v, u -> u = j)), 2D))"
    steps = f"sequence(1, {n} - 1)"
    runs = f"(1 + size(filter({steps}, i -> (e.v[i] >= e.k / 2) <> (e.v[i - 1] >= e.k / 2))))"
    serial = f"aggregate({steps}, 0D, (s, i) -> s + (e.v[i] - (e.k - 1) / 2) * (e.v[i - 1] - (e.k - 1) / 2))"
    letters = "(e.low + e.up)"
    two = f"(pow(e.digits - {n} * 10 / e.k, 2D) / ({n} * 10 / e.k) + pow({letters} - {n} * (e.k - 10) / e.k, 2D) / ({n} * (e.k - 10) / e.k))"
    three = f"(pow(e.low - {n} * 26D / 64, 2D) / ({n} * 26D / 64) + pow(e.up - {n} * 26D / 64, 2D) / ({n} * 26D / 64) + pow({n} - e.low - e.up - {n} * 12D / 64, 2D) / ({n} * 12D / 64))"
    # The even-alphabet statistic is scaled to its exact variance for n draws.
    even = f"((e.k - 1) + (e.k * {squares} / {n} - {n} - (e.k - 1)) / sqrt(1D - 1D / {n}))"
    tests = f"""array({_chi_tail(even, "e.k - 1")}, case when e.enc = 3 then {_chi_tail(three, "2D")} else {_chi_tail(two, "1D")} end,
        2 * {_tail(f"abs({runs} - 1 - ({n} - 1) / 2D) / sqrt(({n} - 1) / 4D)")}, 2 * {_tail(f"abs({serial}) / (sqrt({n} - 1) * (e.k * e.k - 1) / 12)")})"""
    fisher = f"aggregate({tests}, 0D, (s, p) -> s - 2 * ln(greatest(1e-12D, least(1D, p))))"
    tested = f"transform({valued}, e -> named_struct('start', e.start, 'end', e.`end`, 'enc', e.enc, 'n', {n}, 'x', {fisher}))"
    return f"transform({tested}, e -> named_struct('start', e.start, 'end', e.`end`, 'stratum', e.enc * {CLASSES} + cast(least({CLASSES - 1}, floor(2 * log2(e.n / 18D))) as int), 'p', {_chi_tail('e.x', '8D')}))"


def cuts_of(histogram: dict[tuple[int, int], int], false_share: float = FALSE_SHARE) -> dict[int, float]:
    """Least p to accept, by stratum, from counts by (stratum, bin of p)."""
    out = {}
    for stratum in {s for s, _ in histogram}:
        counts = [histogram.get((stratum, b), 0) for b in range(BINS)]
        total = sum(counts)
        if total < LEAST:
            continue
        random = min(total, 2 * sum(counts[BINS // 2 :]))
        passed, cut = 0, 1.01
        for b in range(BINS - 1, -1, -1):
            passed += counts[b]
            if passed and 1 - random * (1 - b / BINS) / passed <= false_share:
                cut = b / BINS
        out[stratum] = max(cut, 1 / BINS)
    return out


def scan_secrets(docs: DataFrame, false_share: float = FALSE_SHARE) -> DataFrame:
    """Every row of docs (doc_id, text) with its spans: doc_id, base and found (arrays of struct(start, kind, end), sorted)."""
    rows = docs.select("doc_id", text_of().alias("t"))
    tokens = rows.select(F.explode(F.expr(tested_tokens())).alias("z")).select("z.stratum", F.least(F.lit(BINS - 1), F.floor(F.col("z.p") * BINS)).cast("int").alias("bin"))
    counts = {(r["stratum"], r["bin"]): r["n"] for r in tokens.groupBy("stratum", "bin").agg(F.count(F.lit(1)).alias("n")).collect()}
    cuts = cuts_of(counts, false_share)
    strata = len(ALPHABETS) * CLASSES
    table = "array(" + ", ".join(f"{cuts.get(s, DEFAULT_CUT)!r}D" for s in range(strata)) + ")"
    apart = "not exists(base, b -> b.start < z.`end` and z.start < b.`end`)"
    found = f"transform(filter({tested_tokens()}, z -> z.p >= {table}[z.stratum] and {apart}), z -> named_struct('start', z.start, 'kind', 3, 'end', z.`end`))"
    # array_sort orders by start, then kind, then end.
    return rows.withColumn("base", F.expr(f"array_sort({base_spans()})")).select("doc_id", "base", F.expr(f"array_sort(concat(base, {found}))").alias("found"))


def _written(spans: str) -> str:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return f"array_join(transform({spans}, z -> concat({names}[z.kind], ':', z.start, ':', z.`end`)), ',')"


def secret_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row of docs."""
    counts = [F.expr(f"cast(size(filter(base, z -> z.kind = {i})) as bigint)").alias(f"n_{k}") for i, k in enumerate(KINDS[:3])]
    return scan_secrets(docs).select("doc_id", *counts, F.expr(f"sha2({_written('base')}, 256)").alias("base_sha256"), F.expr(_written("found")).alias("spans"))
