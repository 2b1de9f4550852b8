"""Scalar functions as column expressions: paths, messages, people, scores, cursors."""

from __future__ import annotations

import base64
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronofold.functions import fixed as V


def _any(column: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | column.rlike("(?i)" + p)
    return out


# -- paths ------------------------------------------------------------------------------------------------------
def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-case extension; a name that starts with its only dot has none."""
    return F.lower(F.regexp_extract(basename(path), r"^.+\.([^.]*)$", 1))


def is_lockfile(path: Column) -> Column:
    return basename(path).isin(V.LOCKFILES)


def _has_segment(path: Column, names: list[str]) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(n) for n in names]))


def is_vendored(path: Column) -> Column:
    out = _has_segment(path, [v for v in V.VENDORED if "/" not in v])
    for part in (v for v in V.VENDORED if "/" in v):
        out = out | path.contains(part)
    return out


def is_generated(path: Column) -> Column:
    return _has_segment(path, V.GENERATED_SEGMENTS) | _any(path, V.GENERATED_PATTERNS)


def is_test(path: Column) -> Column:
    return _has_segment(path, V.TEST_SEGMENTS) | path.rlike("(?i)" + V.TEST_FILE)


def is_binary_path(path: Column) -> Column:
    return extension(path).isin(V.BINARY_EXTENSIONS)


def is_manifest(path: Column, names: list[str] = V.MANIFESTS) -> Column:
    return basename(path).isin(names)


def is_public_api(path: Column) -> Column:
    return basename(path).isin(V.PUBLIC_API)


def file_flags(path: Column) -> Column:
    """Bits: generated (lockfiles too), vendored, test, binary."""
    tests = {"generated": is_generated(path) | is_lockfile(path), "vendored": is_vendored(path), "test": is_test(path), "binary": is_binary_path(path)}
    out = F.lit(0)
    for name, is_so in tests.items():
        out = out + F.when(is_so, V.FILE_FLAGS[name]).otherwise(0)
    return out


def language(path: Column) -> Column:
    """Language by extension, null if unknown."""
    pairs = [F.lit(x) for pair in V.LANGUAGES.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), extension(path))


def top_directory(path: Column) -> Column:
    """First segment, null for files at the root."""
    return F.when(path.contains("/"), F.substring_index(path, "/", 1))


def flag_names(bits: Column, table: dict[str, int]) -> Column:
    """Names of the set bits, in the order of the table."""
    return F.array_compact(F.array(*[F.when(bits.bitwiseAND(b) != 0, F.lit(n)) for n, b in table.items()]))


def flag_bits(names: Column, table: dict[str, int]) -> Column:
    out = F.lit(0)
    for n, b in table.items():
        out = out + F.when(F.array_contains(names, n), b).otherwise(0)
    return out


def kind_code(name: Column, names: list[str], base: int) -> Column:
    """Position of a name in its list, counted from base; unknown names are an error."""
    at = F.array_position(F.array(*[F.lit(n) for n in names]), name)
    return F.when(at > 0, (at + (base - 1)).cast("int")).otherwise(F.raise_error(F.concat(F.lit("unknown kind: "), name)).cast("int"))


def kind_name(code: Column, names: list[str], base: int) -> Column:
    out = F.get(F.array(*[F.lit(n) for n in names]), code - base)
    return F.when(out.isNotNull(), out).otherwise(F.raise_error(F.concat(F.lit("unknown code: "), code.cast("string"))))


#: White space as Java patterns have it.
WHITE = " \t\n\x0b\f\r"


# -- messages ----------------------------------------------------------------------------------------------------
def first_line(message: Column) -> Column:
    return F.trim(F.substring_index(message, "\n", 1))


def is_fix(subject: Column) -> Column:
    return F.trim(subject).rlike("(?i)" + V.FIX_SUBJECT)


def is_mechanical(subject: Column) -> Column:
    return _any(F.trim(subject), [V.MECHANICAL_TOOL, V.MECHANICAL_VERB])


def _paragraphs(message: Column) -> Column:
    """Paragraphs behind the first line."""

    def behind(clean: Column) -> Column:
        rest = F.regexp_replace(clean, r"^[^\n]*\n+", "")
        return F.when(clean.contains("\n"), F.split(rest, r"\n{2,}")).otherwise(F.array().cast("array<string>"))

    return let(F.rtrim(_line_feeds(message), F.lit(WHITE)), behind)


def _line_feeds(message: Column) -> Column:
    return F.replace(message, F.lit("\r\n"), F.lit("\n"))


def _is_trailer_block(paragraph: Column) -> Column:
    """Every line with text is a trailer, or a continuation behind one."""
    lines = F.filter(F.split(paragraph, "\n"), lambda x: x.rlike(r"\S"))
    return (F.size(lines) > 0) & F.forall(lines, lambda x: x.rlike(V.TRAILER_LINE) | x.rlike(r"^\s+\S")) & F.get(lines, 0).rlike(V.TRAILER_LINE)


def let(value: Column, f) -> Column:
    """f of a value that is worked out once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _trailers(block: Column) -> Column:
    lines = F.filter(F.split(F.regexp_replace(block, r"\n+[ \t]+(?=\S)", " "), "\n"), lambda x: x.rlike(V.TRAILER_LINE))
    return F.transform(lines, lambda x: F.struct(F.lower(F.regexp_extract(x, V.TRAILER_LINE, 1)).alias("key"), F.trim(F.regexp_extract(x, V.TRAILER_LINE, 2)).alias("value")))


def message_parts(message: Column) -> Column:
    """struct(subject, body, trailers): the last paragraph is a trailer block or text; keys in lower case, continuations joined."""

    def parts_of(parts: Column) -> Column:
        last = F.get(parts, F.size(parts) - 1)
        return let(F.coalesce(_is_trailer_block(last), F.lit(False)), lambda has: split(parts, last, has))

    def split(parts: Column, last: Column, has: Column) -> Column:
        text = F.when(has, F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
        body = F.nullif(F.trim(F.array_join(text, "\n\n"), F.lit(WHITE)), F.lit(""))
        return F.struct(
            first_line(_line_feeds(message)).alias("subject"),
            body.alias("body"),
            F.when(has, _trailers(last)).otherwise(F.array().cast("array<struct<key:string,value:string>>")).alias("trailers"),
        )

    return let(_paragraphs(message), parts_of)


def trailers_of(message: Column) -> Column:
    """The trailers of ``message_parts``, for which only the last paragraph of a message is taken apart."""

    def last_of(clean: Column) -> Column:
        tail = F.when(clean.contains("\n\n"), F.substring_index(clean, "\n\n", -1)).when(clean.contains("\n"), F.regexp_replace(clean, r"^[^\n]*\n+", ""))
        return let(tail, lambda last: F.when(F.coalesce(_is_trailer_block(last), F.lit(False)), _trailers(last)).otherwise(F.array().cast("array<struct<key:string,value:string>>")))

    ends_white = F.lit(False)
    for x in WHITE:
        ends_white = ends_white | F.endswith(message, F.lit(x))
    # Trimming goes through every character, so messages that need none are left alone.
    clean = F.when(message.contains("\r\n"), F.rtrim(_line_feeds(message), F.lit(WHITE))).when(ends_white, F.rtrim(message, F.lit(WHITE))).otherwise(message)
    return let(clean, last_of)


def co_authors(trailers: Column) -> Column:
    """array<struct<name, email>> of the co-authored-by trailers."""
    those = F.filter(trailers, lambda t: (t["key"] == "co-authored-by") & t["value"].rlike(r"^.*<[^<>]*>\s*$"))
    return F.transform(those, lambda t: F.struct(F.trim(F.regexp_extract(t["value"], r"^(.*?)\s*<([^<>]*)>\s*$", 1)).alias("name"), F.trim(F.regexp_extract(t["value"], r"^(.*?)\s*<([^<>]*)>\s*$", 2)).alias("email")))


def stored_quality(subject: Column, has_body: Column, trailers: Column, repeated: Column) -> Column:
    """The message quality that significance uses, 0 to 1."""
    s = F.trim(subject)
    n = F.length(s)
    score = F.lit(0.15) + F.when((n >= 15) & (n <= 120), 0.3).when(n > 8, 0.15).otherwise(0.0)
    score = score + F.when(has_body, 0.4).otherwise(0.0) + F.when(trailers > 0, 0.15).otherwise(0.0)
    score = score - F.when(s.rlike("(?i)" + V.LOW_EFFORT), 0.35).otherwise(0.0) - F.when(repeated, 0.2).otherwise(0.0)
    return F.when(s == "", 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def message_quality(subject: Column, body: Column, trailers: Column, repeated: Column) -> Column:
    """The finer variant: a short body counts less, more subjects are low effort."""
    s = F.trim(subject)
    n = F.length(s)
    score = F.lit(0.15) + F.when((n >= 15) & (n <= 120), 0.3).when(n > 8, 0.15).otherwise(0.0)
    score = score + F.when(F.length(body) >= 40, 0.4).when(body.isNotNull(), 0.15).otherwise(0.0) + F.when(trailers > 0, 0.15).otherwise(0.0)
    score = score - F.when(s.rlike("(?i)" + V.LOW_EFFORT_WIDE), 0.35).otherwise(0.0) - F.when(repeated, 0.2).otherwise(0.0)
    return F.when(s == "", 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


# -- people -------------------------------------------------------------------------------------------------------
def normal_email(email: Column) -> Column:
    e = F.lower(F.trim(email))
    local, domain = F.regexp_extract(e, r"^(.*)@([^@]*)$", 1), F.regexp_extract(e, r"^(.*)@([^@]*)$", 2)
    hub = "users.noreply.github.com"
    local = F.when((domain == hub) & local.rlike(r"^\d+\+"), F.regexp_replace(local, r"^\d+\+", "")).otherwise(F.when(domain == hub, local).otherwise(F.regexp_replace(local, r"^([^+]+)\+.*$", "$1")))
    local = F.when(domain.isin("gmail.com", "googlemail.com"), F.regexp_replace(local, r"\.", "")).otherwise(local)
    return F.when(e.rlike("^[^@].*@|^[^@]@"), F.concat(local, F.lit("@"), domain)).otherwise(e)


def email_domain(email: Column) -> Column:
    return F.when(email.contains("@"), F.lower(F.substring_index(email, "@", -1))).otherwise("")


def normal_name(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), "[.,_]", " "), r"\s+", " ")


def is_bot(name: Column, email: Column) -> Column:
    return normal_name(name).isin(V.MERGE_QUEUES) | _any(F.trim(email), V.BOT_EMAILS) | _any(F.trim(name), V.BOT_NAMES)


def jaro_winkler(a: str, b: str) -> float:
    """Similarity of two strings; the prefix counts at any level of similarity."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free, mine, places = b, [], []
    for i, ch in enumerate(a):
        j = free.find(ch, max(0, i - reach), i + reach + 1)
        if j >= 0:
            free = free[:j] + "\ud800" + free[j + 1 :]  # half a surrogate pair, which no text holds
            mine.append(ch)
            places.append(j)
    if not mine:
        return 0.0
    places.sort()
    m, swapped = len(mine), sum(x != b[j] for x, j in zip(mine, places))
    jaro = (m / len(a) + m / len(b) + (m - swapped / 2) / m) / 3
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


# -- scores and times ------------------------------------------------------------------------------------------
def saturating(value: Column, cap: int) -> Column:
    return F.least(F.lit(1.0), F.log1p(F.greatest(value, F.lit(0)).cast("double")) / F.log1p(F.lit(float(cap))))


def log_share(value: Column, most: Column) -> Column:
    return F.when(most <= 0, 0.0).otherwise(F.log1p(value.cast("double")) / F.log1p(most.cast("double")))


def days_between(later: Column, earlier: Column) -> Column:
    return F.greatest(F.lit(0), later - earlier) / F.lit(V.DAY)


def recency(now: Column, at: Column) -> Column:
    """Half-life of a year."""
    return F.exp(-days_between(now, at) * F.log(F.lit(2.0)) / V.DECAY_DAYS)


def decayed(amount: Column, now: Column, at: Column) -> Column:
    return amount * F.exp(-days_between(now, at) / V.DECAY_DAYS)


def dilution(n: Column) -> Column:
    return F.exp(-n / V.DECAY_DAYS)


def complexity(source: Column) -> Column:
    """Lines with text times one plus a quarter of their mean indent; a tab counts five."""
    lines = F.filter(F.split(source, "\n"), lambda x: x.rlike(r"\S"))
    lead = F.transform(lines, lambda x: F.regexp_extract(x, r"^[ \t]*", 0))
    indent = F.aggregate(lead, F.lit(0), lambda a, x: a + F.length(x) + 4 * (F.length(x) - F.length(F.replace(x, F.lit("\t"), F.lit("")))))
    n = F.size(lines)
    return F.when(n == 0, 0.0).otherwise(n * (1 + indent / n / 4))


def iso_with_offset(epoch: Column, minutes: Column) -> Column:
    """ISO 8601 in the original offset; the session time zone is UTC."""
    local = F.date_format(F.timestamp_seconds(epoch + minutes * 60), "yyyy-MM-dd'T'HH:mm:ss")
    sign = F.when(minutes < 0, "-").otherwise("+")
    return F.concat(local, sign, F.lpad(F.floor(F.abs(minutes) / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.abs(minutes) % 60).cast("string"), 2, "0"))


def is_oid(oid: Column) -> Column:
    return oid.rlike("^([0-9a-f]{40}|[0-9a-f]{64})$")


def short_oid(oid: Column) -> Column:
    return F.substring(oid, 1, 7)


def repository_id(root_oid: Column, path: Column) -> Column:
    return F.sha2(F.concat(root_oid, F.lit("\0"), path), 256)


def search_tokens(text: Column) -> Column:
    """Lower-case words without diacritics of the common Latin letters."""
    plain = F.translate(F.lower(text), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    return F.regexp_extract_all(plain, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


# -- cursors and targets ---------------------------------------------------------------------------------------
def encode_cursor(committed_at: int, commit_id: int) -> str:
    return base64.urlsafe_b64encode(f"c1:{committed_at}:{commit_id}".encode()).decode().rstrip("=")


def decode_cursor(text: str) -> tuple[int, int] | None:
    """(committed_at, id), or None for anything that ``encode_cursor`` cannot have made."""
    if not re.fullmatch(r"[A-Za-z0-9_-]+", text):
        return None
    try:
        raw = base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)).decode("ascii")
    except ValueError:
        return None
    m = re.fullmatch(r"c1:(0|-?[1-9]\d*):(0|[1-9]\d*)", raw)
    return (int(m[1]), int(m[2])) if m else None


def line_target(text: str) -> tuple[str, int]:
    """path:line with a line from 1."""
    m = re.fullmatch(r"(.+):([1-9][0-9]*)", text)
    if not m:
        raise ValueError(f"not a line target: {text}")
    return m[1], int(m[2])


def page_size(limit: int, most: int = 1000) -> int:
    if not isinstance(limit, int) or isinstance(limit, bool) or limit < 1:
        raise ValueError("limit must be a positive integer")
    return min(limit, most)
