"""Queries by name over the bound history, each with the SQL that gives the same rows in DuckDB.

Doubles are rounded to six digits in both, as sums in another order differ in the last ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.functions import columns as C
from chronofold.functions import fixed as V
from chronofold.operators import lookups as L
from chronofold.operators import rollups as R
from chronofold.plans.bindings import SQL, History

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


def query(sql: str | None = None, bound: bool = True):
    """Registers a function of a History under its name; sql is what DuckDB runs (behind the bound views)."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(History(spark, sf_dir))

        run.__doc__, run.__name__ = f.__doc__, f.__name__
        QUERIES[f.__name__] = run
        if sql:
            _ORACLES[f.__name__] = SQL + sql if bound else sql
        return f

    return add


def r6(c: Column | str, name: str | None = None) -> Column:
    column = F.col(c) if isinstance(c, str) else c
    return F.round(column, 6).alias(name or c)


def _source(h: History, texts: bool = False) -> DataFrame:
    return R.source_changes(h.changes, h.messages if texts else h.commits, h.files)


def _now(h: History) -> Column:
    return F.lit(h.now)


def _owned(h: History) -> DataFrame:
    return R.ownership(R.knowledge(_source(h)), h.people, _now(h))


# -- knowledge, ownership, hotspots ------------------------------------------------------------------------------
@query("select file_id, person_id, round(accumulated, 6) as accumulated, last_at, commits from knowledge")
def knowledge(h: History) -> DataFrame:
    return R.knowledge(_source(h)).select("file_id", "person_id", r6("accumulated"), "last_at", "commits")


@query("select file_id, person_id, round(case when sum(accumulated) over (partition by file_id) > 0 then accumulated / sum(accumulated) over (partition by file_id) else 0 end, 6) as share from knowledge")
def ownership_shares(h: History) -> DataFrame:
    return R.shares(R.knowledge(_source(h))).select("file_id", "person_id", r6("share"))


@query("select file_id, top_person, round(top_share, 6) as top_share, bus_factor, round(entropy, 6) + 0e0 as entropy, contributors from ownership")
def ownership_summary(h: History) -> DataFrame:
    return _owned(h).select("file_id", "top_person", r6("top_share"), F.col("bus_factor").cast("long").alias("bus_factor"), r6(F.round("entropy", 6) + 0.0, "entropy"), "contributors")


@query("select i.file_id, f.path, i.top_person, round(i.top_share, 6) as top_share, i.contributors, round(h.score, 6) as score from isl i join files f using (file_id) left join hotspots h using (file_id) where i.is_island and f.alive")
def knowledge_islands(h: History) -> DataFrame:
    """Living files that one person holds who has been away for more than half a year, with their hotspot score."""
    from chronofold.sources.store import ensure_checkpoint_dir

    ensure_checkpoint_dir(h.spark)
    isl = R.islands(_owned(h), R.last_seen(h.commits), _now(h)).where("is_island").join(h.files.where("alive"), "file_id").checkpoint()
    source = _source(h)
    hot = R.hotspots(source.withColumn("is_fix", F.lit(False)), _now(h)).select("file_id", F.col("score").alias("plain"))
    # The maxima are over all files, but only these files' commits have their texts judged.
    theirs = source.join(isl.select("file_id"), "file_id", "left_semi").select("file_id", "commit_id")
    fixes = h.told(h.commits.join(theirs, "commit_id", "left_semi")).select("commit_id", C.is_fix(F.col("subject")).alias("is_fix"))
    density = theirs.join(fixes, "commit_id").groupBy("file_id").agg(F.avg(F.when(F.col("is_fix"), 1.0).otherwise(0.0)).alias("fix_density"))
    rows = isl.join(hot, "file_id", "left").join(density, "file_id", "left").withColumn("score", F.col("plain") * (1 + F.col("fix_density")))
    return rows.select("file_id", "path", "top_person", r6("top_share"), "contributors", r6("score")).orderBy(F.coalesce("score", F.lit(-1.0)).desc(), "file_id")


@query("select file_id, round(score, 6) as score, cast(churn as bigint) as churn, changes, round(fix_density, 6) as fix_density, peak from hotspots")
def hotspots(h: History) -> DataFrame:
    return R.hotspots(_source(h, True), _now(h)).select("file_id", r6("score"), "churn", "changes", r6("fix_density"), "peak")


@query("select file_id, round(score, 6) as score from hotspots order by round(score, 9) desc, file_id limit 20")
def top_hotspots(h: History) -> DataFrame:
    return R.hotspots(_source(h, True), _now(h)).orderBy(F.round("score", 9).desc(), "file_id").limit(20).select("file_id", r6("score"))


@query(
    "select f.file_id, round((now.t - b.born) / 86400e0, 6) as age_days, cast(b.churn as bigint) as churn, round(coalesce(o.top_share, 0), 6) as ownership, round(coalesce(h.score, 0), 6) as hotspot, round(coalesce(o.top_share / o.bus_factor, 0), 6) as knowledge_risk "
    "from files f join (select file_id, min(authored_at) as born, sum(churn) as churn from source group by all) b using (file_id) left join ownership o using (file_id) left join hotspots h using (file_id), now"
)
def lens_values(h: History) -> DataFrame:
    out = R.lenses(h.files, _source(h), _owned(h), R.hotspots(_source(h, True), _now(h)), _now(h))
    return out.select("file_id", r6("age_days"), "churn", r6("ownership"), r6("hotspot"), r6("knowledge_risk"))


# -- messages and significance ---------------------------------------------------------------------------------
@query("select lower(trim(subject)) as subject, count(*) as n from messages group by all having count(*) >= 3")
def repeated_subjects(h: History) -> DataFrame:
    return R.repeated_subjects(h.messages)


_RARITY = "rar as (select x.commit_id, greatest(0e0, least(1e0, avg(ln(t.n / greatest(1e0, cnt.n)) / ln(t.n + 1e0)))) as rarity from changes x join files f using (file_id) join (select path, count(*) as n from changes join files using (file_id) group by path) cnt using (path), (select cast(count(*) as double) as n from commits) t group by x.commit_id)"


@query(f", {_RARITY} select commit_id, round(rarity, 6) as rarity from rar")
def path_rarity(h: History) -> DataFrame:
    n = h.commits.count()
    return R.path_rarity(h.changes, h.files, F.lit(n)).select("commit_id", r6("rarity"))


@query("select split_part(path, '/', 1) as directory, min(commit_id) as commit_id from changes join files using (file_id) where contains(path, '/') group by all")
def first_touch_dirs(h: History) -> DataFrame:
    return R.first_touches(h.changes, h.files)


_FLAGS = """ff as (select x.commit_id, count(*) as n_files, sum(case when is_binary then 0 else insertions + deletions end) as churn, bool_and(m = 2) as lock, bool_and(m in (0, 2)) as gen, bool_and(m = 1) as vend,
  count(case when not is_binary then 1 end) as n_lines, avg(case when not is_binary then insertions + deletions end) as mean, stddev_pop(case when not is_binary then insertions + deletions end) as sd from changes x join files using (file_id) group by x.commit_id),
np as (select child_id as commit_id, count(*) as n_parents from parents group by all),
fl0 as (select m.commit_id, trim(m.subject) as s, coalesce(n_files, 0) as n_files, coalesce(churn, 0) as churn, coalesce(n_parents, 0) as n_parents, ff.* exclude (commit_id, n_files, churn) from messages m left join ff using (commit_id) left join np using (commit_id)),
fl as (select commit_id, n_files, churn, n_parents, cast((case when n_parents > 1 then 1 else 0 end) + (case when n_parents = 0 then 2 else 0 end) + (case when regexp_matches(s, '(?i)^revert[:\\s"]') then 4 else 0 end) + (case when regexp_matches(s, '(?i)^re-?land\\b|^reapply\\b') then 8 else 0 end)
  + (case when n_files = 0 then 16 else 0 end) + (case when n_files > 0 and gen and not lock then 128 else 0 end) + (case when n_files > 0 and vend then 256 else 0 end) + (case when n_files > 0 and lock then 512 else 0 end)
  + (case when n_files >= 30 and (coalesce(n_lines >= 30 and (mean = 0 or sd / mean < 0.35), false) or regexp_matches(s, '(?i)^chore: run formatter\\b')) then 1024 else 0 end)
  + (case when commit_id in (select commit_id from hunks group by commit_id having count(*) = count(case when kind = 1 then 1 end)) then 64 else 0 end) as integer) as flags from fl0)"""


@query(f", {_FLAGS} select commit_id, flags from fl")
def commit_flags(h: History) -> DataFrame:
    return R.commit_flags(h.messages, h.changes, h.files, h.parents, R.format_only_commits(h.hunks)).select("commit_id", "flags")


@query("select commit_id from hunks group by commit_id having count(*) = count(case when kind = 1 then 1 end)")
def format_only_commits(h: History) -> DataFrame:
    return R.format_only_commits(h.hunks)


@query(f", {_FLAGS} select u.name, count(*) as n from fl, (select unnest(['merge','root','revert','reland','empty','format-only','generated-only','vendored-only','lockfile-only','bulk-mechanical']) as name, unnest([1,2,4,8,16,64,128,256,512,1024]) as bit) u where (flags & bit) <> 0 group by all")
def noise_flags(h: History) -> DataFrame:
    rows = R.commit_flags(h.messages, h.changes, h.files, h.parents, R.format_only_commits(h.hunks))
    return rows.select(F.explode(C.flag_names(F.col("flags"), V.COMMIT_FLAGS)).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


_QUALITY = """q as (select commit_id, subject, case when s = '' then 0e0 else greatest(0e0, least(1e0, 0.15e0 + (case when length(s) between 15 and 120 then 0.3e0 when length(s) > 8 then 0.15e0 else 0e0 end) + (case when has_body then 0.4e0 else 0e0 end)
  + (case when n_trailers > 0 then 0.15e0 else 0e0 end) - (case when regexp_matches(s, '(?i)^(?:wip|fix|update|updates|changes|cleanup|misc|stuff|tmp|temp|minor|typo|\\.+)$') then 0.35e0 else 0e0 end)
  - (case when count(*) over (partition by lower(s)) >= 3 then 0.2e0 else 0e0 end))) end as quality from (select *, trim(subject) as s from messages))"""


@query(f", {_QUALITY} select commit_id, round(quality, 6) as quality from q")
def message_quality(h: History) -> DataFrame:
    again = R.repeated_subjects(h.messages).select(F.col("subject").alias("_k"), F.lit(True).alias("again"))
    rows = h.messages.withColumn("_k", F.lower(F.trim("subject"))).join(again, "_k", "left")
    return rows.select("commit_id", r6(C.stored_quality(F.col("subject"), F.col("has_body"), F.col("n_trailers"), F.coalesce("again", F.lit(False))), "quality"))


_SIG = f""", {_RARITY}, {_FLAGS}, {_QUALITY},
tch as (select x.commit_id, bool_or(m = 3) as manifest, bool_or(m = 4) as api from changes x join files using (file_id) group by x.commit_id),
nd as (select distinct min(commit_id) as commit_id from changes join files using (file_id) where contains(path, '/') group by split_part(path, '/', 1)),
rel as (select distinct target_id as commit_id from tags where regexp_matches(name, '^v[0-9]') or regexp_matches(name, '^[0-9].*\\.')),
sig as (select q.commit_id, fl.flags, case when (fl.flags & 16) <> 0 then 0e0 else greatest(0e0, 0.8e0 * least(1e0, ln(1 + n_files) / ln(51e0)) + 0.7e0 * least(1e0, ln(1 + churn) / ln(2001e0)) + 1.5e0 * quality + 1.2e0 * coalesce(rarity, 0)
  + (case when rel.commit_id is not null then 1.6e0 else 0 end) + (case when (fl.flags & 12) <> 0 then 2.2e0 else 0 end) + (case when manifest then 1.1e0 else 0 end) + (case when api then 1e0 else 0 end) + (case when nd.commit_id is not null then 1.4e0 else 0 end)
  + (case when n_parents > 1 and n_files >= 5 then 0.9e0 else 0 end) - (case when (fl.flags & 64) <> 0 then 4e0 else 0 end) - (case when (fl.flags & 128) <> 0 then 4.5e0 else 0 end) - (case when (fl.flags & 256) <> 0 then 4e0 else 0 end)
  - (case when (fl.flags & 512) <> 0 then 5e0 else 0 end) - (case when (fl.flags & 1024) <> 0 then 4.5e0 else 0 end)) end as significance
  from q join fl using (commit_id) left join rar using (commit_id) left join tch using (commit_id) left join nd using (commit_id) left join rel using (commit_id))"""


def _significance(h: History) -> DataFrame:
    return R.significance(h.messages, h.changes, h.files, h.parents, h.tags, R.format_only_commits(h.hunks))


@query(_SIG + " select commit_id, flags, round(significance, 6) as significance from sig")
def significance(h: History) -> DataFrame:
    return _significance(h).select("commit_id", "flags", r6("significance"))


@query(_SIG + " select commit_id, round(significance, 6) as significance from sig order by round(significance, 6) desc, commit_id desc limit 25")
def most_significant(h: History) -> DataFrame:
    return significance(h).select("commit_id", "significance").orderBy(F.col("significance").desc(), F.col("commit_id").desc()).limit(25)


@query(
    _SIG + " select commit_id, author_id, subject, significance from (select *, row_number() over (partition by author_id, lower(trim(subject)) order by significance desc, commit_id desc) as rn from (select commit_id, author_id, subject, round(significance, 6) as significance"
    " from sig join messages m using (commit_id, subject) order by 4 desc, commit_id desc limit 40)) where rn = 1 order by significance desc, commit_id desc limit 10".replace("sig join messages m using (commit_id, subject)", "sig join messages m using (commit_id)")
)
def distinct_significant(h: History) -> DataFrame:
    best = significance(h).select("commit_id", "significance").orderBy(F.col("significance").desc(), F.col("commit_id").desc()).limit(40)
    few = h.spark.createDataFrame(best.collect(), best.schema)  # only these get their texts
    rows = h.told(h.commits.join(F.broadcast(few), "commit_id", "left_semi"), few=True).join(F.broadcast(few), "commit_id")
    return L.distinct_summaries(rows.select("commit_id", "author_id", "subject", "significance"), 10)


@query("select commit_id, subject, case when body <> '' then body end as body, n_trailers as trailers from messages")
def message_parts(h: History) -> DataFrame:
    rows = h.messages.select("commit_id", C.message_parts(F.col("message")).alias("m"))
    return rows.select("commit_id", "m.subject", "m.body", F.size("m.trailers").alias("trailers"))


@query("select regexp_extract(helper, ': (.*) <', 1) as name, regexp_extract(helper, '<(.*)>', 1) as email, count(*) as commits from messages where helper is not null group by all")
def coauthors(h: History) -> DataFrame:
    rows = h.messages.select(F.explode(C.co_authors(C.trailers_of(F.col("message")))).alias("c"))
    return rows.select("c.name", "c.email").groupBy("name", "email").agg(F.count(F.lit(1)).alias("commits"))


@query(
    "select distinct commit_id, kind, reference from (select commit_id, 'pull-request' as kind, unnest(regexp_extract_all(subject, '\\(#(\\d+)\\)', 1)) as reference from messages union all select commit_id, 'pull-request', regexp_extract(subject, '^Merge pull request #(\\d+)', 1) from messages "
    "union all select commit_id, 'pull-request', regexp_extract(review, '^PR-URL: .*/pull/(\\d+)$', 1) from messages union all select commit_id, 'change-id', regexp_extract(review, '^Change-Id: (.*)$', 1) from messages) where reference <> ''"
)
def pr_references(h: History) -> DataFrame:
    """Pull requests and change ids that messages name."""
    from chronofold.operators.evidence import references

    return references(h.messages)


@query(
    "select r.commit_id as revert_id, max(o.commit_id) as reverted_id from messages r join messages o on lower(trim(substr(regexp_replace(r.subject, ' \\(#\\d+\\)$', ''), 8))) = lower(regexp_replace(regexp_replace(o.subject, ' \\(#\\d+\\)$', ''), '^(fix|feat|refactor|chore): ', '')) and o.commit_id < r.commit_id "
    "where starts_with(r.subject, 'Revert ') and not starts_with(o.subject, 'Revert ') and trim(substr(r.subject, 8)) <> '' and exists (select 1 from changes a join changes b using (file_id) where a.commit_id = r.commit_id and b.commit_id = o.commit_id) group by all"
)
def revert_pairs_message(h: History) -> DataFrame:
    """Third tier: a revert whose subject names an earlier commit's and that shares a file with it; the latest such commit."""
    from chronofold.operators.evidence import revert_pairs_by_message

    return revert_pairs_by_message(h.messages, h.changes)


# -- coupling, time, people ------------------------------------------------------------------------------------
_CPL = """small as (select commit_id, file_id from (select *, count(*) over (partition by commit_id) as n from changes) where n <= 30), fc as (select file_id, count(*) as n from small group by all),
cp0 as (select a.file_id as file_a, b.file_id as file_b, count(*) as co_changes from small a join small b on a.commit_id = b.commit_id and a.file_id < b.file_id group by all having count(*) >= 2),
cpl as (select file_a, file_b, co_changes, co_changes / cast(x.n + y.n - co_changes as double) as strength, co_changes / cast(least(x.n, y.n) as double) as strength_min from cp0 join fc x on x.file_id = file_a join fc y on y.file_id = file_b)"""


def _coupling(h: History) -> DataFrame:
    return R.coupling(h.changes, rows=h.table("lineitem").count())  # a change has one line or more


@query(f", {_CPL} select file_a, file_b, co_changes, round(strength, 6) as strength, round(strength_min, 6) as strength_min from cpl")
def coupling(h: History) -> DataFrame:
    return _coupling(h).select("file_a", "file_b", "co_changes", r6("strength"), r6("strength_min"))


@query(f", {_CPL}, bi as (select file_a as file_id, file_b as partner, co_changes, strength from cpl union all select file_b, file_a, co_changes, strength from cpl) select file_id, partner, co_changes, round(strength, 6) as strength from (select *, row_number() over (partition by file_id order by strength desc, co_changes desc, partner) as rn from bi) where rn <= 3")
def coupled_with(h: History) -> DataFrame:
    return R.coupled_with(_coupling(h), 3).select("file_id", "partner", "co_changes", r6("strength"))


def _timeline_sql(grain: str) -> str:
    return f"select cast(cast(date_trunc('{grain}', to_timestamp(authored_at) at time zone 'UTC') as date) as varchar) as bucket, count(*) as commits, cast(coalesce(sum(i), 0) as bigint) as insertions, cast(coalesce(sum(d), 0) as bigint) as deletions, count(distinct author_id) as authors from commits left join (select commit_id, sum(insertions) as i, sum(deletions) as d from changes group by all) using (commit_id) group by 1"


@query(_timeline_sql("day"))
def timeline_day(h: History) -> DataFrame:
    return R.timeline(h.commits, h.changes, "day").withColumn("bucket", F.col("bucket").cast("string"))


@query(_timeline_sql("week"))
def timeline_week(h: History) -> DataFrame:
    return R.timeline(h.commits, h.changes, "week").withColumn("bucket", F.col("bucket").cast("string"))


@query(_timeline_sql("month"))
def timeline_month(h: History) -> DataFrame:
    return R.timeline(h.commits, h.changes, "month").withColumn("bucket", F.col("bucket").cast("string"))


_ERA = """er as (select commit_id, author_id, cast(date_trunc('week', to_timestamp(authored_at) at time zone 'UTC') as date) as week from commits), ew as (select week, count(*) as commits, count(distinct author_id) as authors from er group by all),
ed as (select week, case when contains(path, '/') then split_part(path, '/', 1) else '' end as directory, count(*) as n, sum(insertions - deletions) as delta from changes join er using (commit_id) join files using (file_id) group by all),
es as (select week, -sum(p * log2(p)) as entropy, sum(delta) as loc_delta from (select *, n / sum(n) over (partition by week) as p from ed) group by week),
ex as (select week, regexp_extract(path, '\\.([^./]*)$', 1) as extension, cast(count(*) as double) as n from changes join er using (commit_id) join files using (file_id) group by all),
en as (select week, sqrt(sum(n * n)) as norm, row_number() over (order by week) as nth from ex group by week),
em as (select c.week, case when p.week is null then 0e0 else 1 - coalesce((select sum(x.n * y.n) from ex x join ex y using (extension) where x.week = c.week and y.week = p.week), 0) / (c.norm * p.norm) end as extension_mix from en c left join en p on p.nth = c.nth - 1),
era as (select * from ew left join es using (week) left join em using (week))"""


@query(f", {_ERA} select cast(week as varchar) as week, commits, authors, round(entropy, 6) as entropy, cast(loc_delta as bigint) as loc_delta, round(extension_mix, 6) + 0e0 as extension_mix from era")
def era_series(h: History) -> DataFrame:
    return R.era_series(h.commits, h.changes, h.files).select(F.col("week").cast("string").alias("week"), "commits", "authors", r6("entropy"), "loc_delta", r6(F.round("extension_mix", 6) + 0.0, "extension_mix"))


@query(f", {_ERA}, md as (select median(commits) as a, median(authors) as b from era), mm as (select median(abs(commits - a)) as sa, median(abs(authors - b)) as sb from era, md) select cast(week as varchar) as week, round(coalesce((commits - a) / nullif(sa * 1.4826, 0), 0), 6) as commits, round(coalesce((authors - b) / nullif(sb * 1.4826, 0), 0), 6) as authors from era, md, mm")
def era_scores(h: History) -> DataFrame:
    s = R.robust_scores(R.era_series(h.commits, h.changes, h.files), ["commits", "authors"])
    return s.select(F.col("week").cast("string").alias("week"), r6("commits"), r6("authors"))


@query()
def era_boundaries(h: History) -> DataFrame:
    """Weeks at which an era begins, from binary segmentation of the weekly series, snapped to releases."""
    from chronofold.operators.evidence import eras

    return eras(R.era_series(h.commits, h.changes, h.files), h.tags)


@query("select tag_id, name, tagged_at, cast(lag(tag_id) over o as double) as prev_id, cast(lag(target_id) over o + 1 as double) as from_commit, target_id as to_commit from tags where regexp_matches(name, '^v[0-9]') or regexp_matches(name, '^[0-9].*\\.') window o as (order by tagged_at, tag_id)")
def releases_chain(h: History) -> DataFrame:
    return R.releases(h.tags).withColumns({c: F.col(c).cast("double") for c in ("prev_id", "from_commit")})


@query("select distinct target_id as commit_id from tags where regexp_matches(name, '^v[0-9]') or regexp_matches(name, '^[0-9].*\\.')")
def release_commits(h: History) -> DataFrame:
    return R.release_commits(h.tags)


@query("select person_id, name, coalesce(n, 0) as commit_count from people left join (select author_id as person_id, count(*) as n from commits group by all) using (person_id) where not is_bot")
def people_by_commits(h: History) -> DataFrame:
    return L.people_by_commits(h.people, h.commits).select("person_id", "name", "commit_count")


@query("select count(*) as people, cast(coalesce(sum(n), 0) as bigint) as commits from (select person_id, count(*) as n, row_number() over (order by count(*) desc, any_value(name), person_id) as rn from commits join people on person_id = author_id where not is_bot group by person_id) where rn > 10")
def contributor_tail(h: History) -> DataFrame:
    return R.contributor_tail(h.commits, h.people, 10)


@query("select person_id, 'customer' || (person_id - 1) || '@' || lower(replace(split_part(email, '@', 2), ' ', '-')) as email, lower(split_part(email, '@', 2)) as domain from people")
def email_normalise(h: History) -> DataFrame:
    return h.people.select("person_id", C.normal_email(F.col("email")).alias("email"), C.email_domain(F.col("email")).alias("domain"))


@query("select person_id, lower(trim(replace(replace(name, '.', ' '), '#', '#'))) as name, false as is_bot from people")
def bot_flags(h: History) -> DataFrame:
    return h.people.select("person_id", C.normal_name(F.col("name")).alias("name"), C.is_bot(F.col("name"), F.col("email")).alias("is_bot"))


@query("with n as (select distinct lower(trim(p_name)) as name from part where p_name <> '') select a.name as a, b.name as b, round(jaro_winkler_similarity(a.name, b.name), 6) as similarity from n a join n b on a.name < b.name where jaro_winkler_similarity(a.name, b.name) >= 0.92", bound=False)
def name_similarity(h: History) -> DataFrame:
    """All pairs of similar names among the different names of parts (people's names are all alike in these tables)."""
    from chronofold.operators.lineage import similar_names

    names = h.table("part").select(C.normal_name(F.col("p_name")).alias("name"))
    return similar_names(names).select("a", "b", r6("similarity"))


# -- files, pages, intervals, search ----------------------------------------------------------------------------
@query("select file_id, cast((case when m in (0, 2) then 1 else 0 end) + (case when m = 1 then 2 else 0 end) + (case when m = 5 then 4 else 0 end) + (case when m = 6 then 8 else 0 end) as integer) as flags from files")
def path_flags(h: History) -> DataFrame:
    return h.files.select("file_id", C.file_flags(F.col("path")).alias("flags"))


@query("select file_id from files where m in (0, 1, 2)")
def non_source_files(h: History) -> DataFrame:
    return h.files.where(C.file_flags(F.col("path")).bitwiseAND(V.NON_SOURCE) != 0).select("file_id")


@query("select case regexp_extract(path, '\\.([^.]*)$', 1) when 'js' then 'JavaScript' when 'go' then 'Go' when 'json' then 'JSON' when 'toml' then 'TOML' when 'ts' then 'TypeScript' when 'py' then 'Python' when 'md' then 'Markdown' when 'rs' then 'Rust' when 'java' then 'Java' end as language, count(*) as files from files group by all")
def languages(h: History) -> DataFrame:
    return h.files.groupBy(C.language(F.col("path")).alias("language")).agg(F.count(F.lit(1)).alias("files"))


@query("select commit_id, committed_at from commits order by committed_at desc, commit_id desc limit 101")
def commit_page(h: History) -> DataFrame:
    return L.commit_page(h.commits.select("commit_id", "committed_at"), 100)


@query("select commit_id, committed_at from commits, now where (committed_at, commit_id) < (t - 86400 * 30, 500) order by committed_at desc, commit_id desc limit 101")
def commit_page_keyset(h: History) -> DataFrame:
    return L.commit_page(h.commits.select("commit_id", "committed_at"), 100, C.decode_cursor(C.encode_cursor(h.now - 86400 * 30, 500)))


@query("select commit_id, author_id, cast(coalesce(i, 0) as bigint) as insertions, cast(coalesce(d, 0) as bigint) as deletions, coalesce(n, 0) as files, coalesce(p, '') as parents from commits left join (select commit_id, sum(insertions) as i, sum(deletions) as d, count(*) as n from changes group by all) using (commit_id) left join (select child_id as commit_id, string_agg(parent_id::varchar, ',' order by ordinal) as p from parents group by all) using (commit_id)")
def commit_summary(h: History) -> DataFrame:
    rows = L.commit_summaries(h.commits, h.changes, h.parents)
    return rows.select("commit_id", "author_id", "insertions", "deletions", "files", F.array_join(F.col("parents").cast("array<string>"), ",").alias("parents"))


@query("select child_id, parent_id, ordinal from parents")
def parents_of(h: History) -> DataFrame:
    return h.parents


@query("select a.path, c.commit_id, cast(b.file_id as double) as file_id from aliases a join (select unnest([1, 50, 400, 999, 5000]) as commit_id) c on true left join aliases b on b.path = a.path and b.from_commit <= c.commit_id and (b.to_commit is null or b.to_commit > c.commit_id)")
def path_as_of(h: History) -> DataFrame:
    asked = h.aliases.select("path").distinct().select("path", F.explode(F.array(*[F.lit(x).cast("long") for x in (1, 50, 400, 999, 5000)])).alias("commit_id"))
    return L.path_as_of(h.aliases, asked).withColumn("file_id", F.col("file_id").cast("double"))


@query("select distinct commit_id, committed_at from hunks join commits using (commit_id) where file_id = 11 and new_start <= 59 and new_start + new_len > 20")
def commits_touching_range(h: History) -> DataFrame:
    return L.commits_touching(h.hunks, h.commits, 11, 20, 60)


@query("select f.file_id, r.s as start, r.e as \"end\", x.commit_id, x.new_start, x.new_len from files f, (select unnest([1, 30]) as s, unnest([15, 45]) as e) r, hunks x where x.file_id = f.file_id and x.new_len > 0 and x.new_start < r.e and x.new_start + x.new_len > r.s")
def range_join_hunks(h: History) -> DataFrame:
    pair = F.struct(F.lit(1).alias("start"), F.lit(15).alias("end")), F.struct(F.lit(30).alias("start"), F.lit(45).alias("end"))
    ranges = h.files.select("file_id", F.explode(F.array(*pair)).alias("r")).select("file_id", "r.start", "r.end")
    return L.overlapping_hunks(h.hunks, ranges)


@query("with recursive commits as (select o_orderkey + 1 as commit_id from orders), up as (select max(commit_id) as commit_id from commits union select p.parent_id from up join (select commit_id as child_id, commit_id - 1 as parent_id from commits where commit_id > 1 union all select commit_id, commit_id - 7 from commits where commit_id > 7 and (commit_id - 1) % 11 = 0) p on p.child_id = up.commit_id) select commit_id from up", bound=False)
def ancestors(h: History) -> DataFrame:
    """The newest commit and all above it."""
    one = F.lit("repo").alias("repo_id")
    newest = h.commits.agg(F.max("commit_id").alias("commit_id")).where("commit_id is not null")
    return L.ancestors_by_repository(h.parents.select(one, "child_id", "parent_id"), newest.select(one, "commit_id")).select("commit_id")


@query("select p.child_id, p.parent_id, p.ordinal from parents p where p.parent_id not in (select commit_id from commits)")
def integrity_parents(h: History) -> DataFrame:
    return L.missing_parents(h.parents, h.commits)


_BM25 = """tk as (select doc_id as id, regexp_extract_all(translate(lower(coalesce(text, '')), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[\\p{L}\\p{N}_]+') as t from documents),
tf as (select id, len(t) as n, len(list_filter(t, lambda x: x = 'the')) as f0, len(list_filter(t, lambda x: starts_with(x, 'thin'))) as f1 from tk),
tt as (select cast(count(*) as double) as docs, avg(n) as mean, sum(case when f0 > 0 then 1 else 0 end) as d0, sum(case when f1 > 0 then 1 else 0 end) as d1 from tf),
bm as (select id, ln(1 + (docs - d0 + 0.5e0) / (d0 + 0.5e0)) * f0 * 2.2e0 / (f0 + 1.2e0 * (0.25e0 + 0.75e0 * n / mean)) + ln(1 + (docs - d1 + 0.5e0) / (d1 + 0.5e0)) * f1 * 2.2e0 / (f1 + 1.2e0 * (0.25e0 + 0.75e0 * n / mean)) as score from tf, tt where f0 > 0 and f1 > 0)"""


@query(f", {_BM25} select id, round(score, 6) as score from bm order by round(score, 9) desc, id desc limit 20")
def fts_search(h: History) -> DataFrame:
    texts = h.table("documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    return L.search_commits(texts, "the thin", 20).select("id", r6("score"))


@query("with a as (select doc_id as id, row_number() over (order by n_chars desc, doc_id) as rank from documents), b as (select doc_id as id, row_number() over (order by source, doc_id) as rank from documents), u as (select * from a where rank <= 100 union all select * from b where rank <= 100) select id, round(sum(1e0 / (60 + rank)), 6) as score from u group by id", bound=False)
def rrf_search(h: History) -> DataFrame:
    from pyspark.sql import Window

    docs = h.table("documents")
    tops = [docs.select("doc_id", "n_chars", "source").orderBy(*o).limit(100) for o in ((F.col("n_chars").desc(), "doc_id"), ("source", "doc_id"))]
    orders = [Window.orderBy(F.col("n_chars").desc(), "doc_id"), Window.orderBy("source", "doc_id")]
    ranked = [t.select(F.col("doc_id").alias("id"), F.row_number().over(o).alias("rank")) for t, o in zip(tops, orders)]  # 100 rows each
    return L.reciprocal_rank_fusion(ranked).select("id", r6("score"))


@query("select doc_id as id, round(case when c = 0 then 0e0 else c * (1 + ind / c / 4) end, 6) as complexity from (select doc_id, cast(len(l) as double) as c, cast(coalesce(list_sum(list_transform(l, lambda x: length(regexp_extract(x, '^[ \\t]*')) + 4 * (length(regexp_extract(x, '^[ \\t]*')) - length(replace(regexp_extract(x, '^[ \\t]*'), chr(9), ''))))), 0) as double) as ind from (select doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '\\S')) as l from documents))", bound=False)
def complexity_proxy(h: History) -> DataFrame:
    texts = h.table("documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    return R.mean_complexity(texts).select("id", r6("complexity"))


@query("select count(*) as commits, count(distinct author_id) as authors, min(authored_at) as first_at, max(authored_at) as last_at, (select count(*) from files) as files, (select count(*) from people) as people, (select count(*) from changes) as changes from commits")
def repository_summary(h: History) -> DataFrame:
    a = h.commits.agg(F.count(F.lit(1)).alias("commits"), F.countDistinct("author_id").alias("authors"), F.min("authored_at").alias("first_at"), F.max("authored_at").alias("last_at"))
    for name in ("files", "people", "changes"):
        a = a.crossJoin(getattr(h, name).agg(F.count(F.lit(1)).alias(name)))  # one row each
    return a


# -- lineage, evidence, streams ---------------------------------------------------------------------------------
@query()
def file_lineage(h: History) -> DataFrame:
    """Aliases of files over a synthetic walk: part of the files are renamed, deleted and added again in their changes' order."""
    from chronofold.operators.lineage import file_aliases

    return file_aliases(_walk(h))


def _walk(h: History) -> DataFrame:
    """Changes as the walk would tell them: kinds by commit number, old paths for renames; a repository for each 500 files."""
    path = F.col("path")
    kind = F.when(F.col("commit_id") % 10 == 3, "rename").when(F.col("commit_id") % 10 == 7, "delete").when(F.col("commit_id") % 10 == 8, "copy").otherwise("modify")
    rows = h.changes.join(h.files.select("file_id", "path"), "file_id").withColumn("kind", kind)
    moved = F.concat(F.lit("moved/"), path)
    old = F.when(F.col("kind").isin("rename", "delete", "copy"), path)
    new = F.when(F.col("kind") == "rename", moved).when(F.col("kind") == "copy", F.concat(F.lit("copy/"), path)).when(F.col("kind") == "modify", path)
    return rows.select(F.concat(F.lit("repo-"), F.floor(F.col("file_id") / 500).cast("string")).alias("repo_id"), "commit_id", F.col("file_id").cast("int").alias("ordinal"), "kind", old.alias("old_path"), new.alias("new_path"))


@query()
def person_merge(h: History) -> DataFrame:
    """People resolved from sightings: authors under two spellings each, committers, co-authors."""
    from chronofold.operators.lineage import people, sightings_of

    who = h.people.select(F.col("person_id").alias("author_id"), "name", "email")
    rows = h.messages.join(who, "author_id")
    plain = F.struct(F.col("name").alias("name"), F.regexp_replace("email", r"\+dev", "").alias("email"))
    spelled = F.struct(F.when(F.col("commit_id") % 3 == 0, F.upper("name")).otherwise(F.col("name")).alias("name"), F.col("email").alias("email"))
    commits = rows.select(F.concat(F.lit("repo-"), (F.col("author_id") % 8).cast("string")).alias("repo_id"), "commit_id", spelled.alias("author"), plain.alias("committer"), "authored_at", "committed_at", "message")
    return people(sightings_of(commits))


@query(
    "with m as (select commit_id, string_agg(file_id || ':' || new_start || ':' || new_len, ',' order by file_id, new_start, new_len) as s from (select l_orderkey + 1 as commit_id, l_partkey + 1 as file_id, cast(1 + l_linenumber * 10 as bigint) as new_start, cast(l_quantity as bigint) as new_len from lineitem) group by all) select r.commit_id as revert_id, max(o.commit_id) as reverted_id from m r join m o on r.s = o.s and o.commit_id < r.commit_id group by all", bound=False
)
def revert_pairs_inverse(h: History) -> DataFrame:
    """Second tier. The bound hunks have equal sides, so a commit undoes the last one with the same hunks."""
    from chronofold.operators.evidence import reverts_inverse

    same = h.hunks.select("commit_id", "file_id", F.col("new_start").alias("old_start"), F.col("new_len").alias("old_len"), "new_start", "new_len")
    return reverts_inverse(same)


@query("select commit_id as revert_id, commit_id - 3 as reverted_id from commits where commit_id > 3 and commit_id % 23 = 0")
def revert_pairs_explicit(h: History) -> DataFrame:
    """First tier, over commits with ids made from their numbers: every 23rd names the third before it."""
    from chronofold.operators.evidence import reverts_named

    oid = lambda c: F.sha1(c.cast("string"))
    n = F.col("commit_id")
    said = F.when((n % 23 == 0) & (n > 3), F.concat(F.lit("This reverts commit "), F.substring(oid(n - 3), 1, 12), F.lit("."))).otherwise("")
    return reverts_named(h.commits.select("commit_id", oid(n).alias("oid"), said.alias("message")))


def _evidence(h: History) -> DataFrame:
    from chronofold.operators import evidence as E

    target = h.files.select(F.col("path").alias("target"), "file_id", F.lit(10).cast("long").alias("start"), F.lit(40).cast("long").alias("end"))
    pairs = E.revert_pairs_by_message(h.messages, h.changes)
    items = E.collect_evidence(target, h.commits, h.changes, h.files, h.hunks, pairs, pr_references(h))
    return E.rank_evidence(items, h.commits, _now(h))


@query()
def evidence_ranked(h: History) -> DataFrame:
    """Ranked and labelled evidence for lines 10 to 40 of every file."""
    return _evidence(h)


@query()
def evidence_bundles(h: History) -> DataFrame:
    """Confidence, gaps and hash of each target's evidence."""
    from chronofold.operators.evidence import bundles

    return bundles(_evidence(h))


@query(
    "with s as (select conv_id * 1000 + turn as id, list_filter(string_split_regex(text, '[.!?]\\s+'), lambda x: regexp_matches(x, '\\w')) as l, len(list_distinct(regexp_extract_all(coalesce(text, ''), '\\d+(?:\\.\\d+)*'))) as numbers from conversations), "
    "t as (select *, case when len(l) > 0 and id % 3 = 0 then 1e0 / len(l) else 0e0 end as r, case when id % 6 = 0 then 1 else 0 end as unknown, case when id % 3 = 0 and id % 6 <> 0 then 0 else numbers end as invented from s) "
    "select id, round(r, 6) as ratio, unknown, invented, case when unknown > 0 or invented > 0 or r < 0.7 then 'reject' when r >= 0.95 then 'accept' else 'downgrade' end as verdict from t",
    bound=False,
)
def citation_check(h: History) -> DataFrame:
    """Citations of answers: every third has one marker in front, of which every second is for nothing; the cited item has the answer's numbers."""
    from chronofold.operators.evidence import check_citations

    key = F.col("conv_id") * 1000 + F.col("turn")
    marker = F.when(key % 6 == 0, "[E9] ").when(key % 3 == 0, "[E1] ").otherwise("")
    text = F.coalesce("text", F.lit(""))
    rows = h.table("conversations").select(key.alias("id"), F.concat(marker, text).alias("text"), F.array(F.lit("E1"), F.lit("E2")).alias("labels"), F.array(text, F.lit("none")).alias("sources"))
    return check_citations(rows)


@query("select strftime(date_trunc('day', ts), '%Y-%m-%d') as day, event_type, count(*) as events, round(sum(value), 4) as value from events group by all", bound=False)
def stream_timeline(h: History) -> DataFrame:
    """Daily counts by event type from a stream over the event files."""
    from chronofold.streaming.timeline import events_stream, run_to_memory, windowed_counts

    rows = run_to_memory(windowed_counts(events_stream(h.spark, f"{h.dir}/events.parquet")), "event_timeline_stream")
    return rows.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "events", F.round("value", 4).alias("value"))


@query("select strftime(date_trunc('day', ts), '%Y-%m-%d') as day, event_type, count(*) as events, round(sum(value), 4) as value from events group by all", bound=False)
def event_timeline(h: History) -> DataFrame:
    """The same windows in batch."""
    from chronofold.streaming.timeline import windowed_counts

    rows = windowed_counts(h.table("events").withColumn("ts", F.col("ts").cast("timestamp")))
    return rows.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "events", F.round("value", 4).alias("value"))


@query()
def treemap_layout(h: History) -> DataFrame:
    """Rectangles of the files by churn, in path order within their top directory."""
    from chronofold.operators.evidence import treemap

    churn = _source(h).groupBy("file_id").agg(F.sum("churn").alias("size"))
    rows = churn.join(h.files, "file_id").select(F.coalesce(C.top_directory(F.col("path")), F.lit("")).alias("directory"), "path", "size")
    return treemap(rows)


@query("select file_id, path, rank from (select file_id, path, case when starts_with(lower(regexp_extract(path, '[^/]*$')), 'file1') then 2 when contains(lower(regexp_extract(path, '[^/]*$')), 'file1') then 1 else 0 end + case when contains(lower(regexp_extract(path, '[^/]*$')), 'src') then 1 else 0 end as rank from files where contains(lower(path), 'file1') and contains(lower(path), 'src')) order by rank desc, length(path), path limit 15")
def path_search(h: History) -> DataFrame:
    return L.search_paths(h.files, "src file1", 15)


@query(
    "select f.commit_id as fix_id, a.file_id, max(b.commit_id) as introduced_by from (select commit_id from messages where starts_with(subject, 'fix: ')) f join hunks a using (commit_id) join hunks b on a.file_id = b.file_id and b.commit_id < f.commit_id and a.new_len > 0 and b.new_len > 0 and b.new_start < a.new_start + a.new_len and b.new_start + b.new_len > a.new_start group by all"
)
def introducing_commits(h: History) -> DataFrame:
    """Commits that wrote the lines which a fix takes away (the bound hunks have equal sides)."""
    both = h.hunks.select("commit_id", "file_id", F.col("new_start").alias("old_start"), F.col("new_len").alias("old_len"), "new_start", "new_len")
    fixes = h.messages.where(F.startswith("subject", F.lit("fix: "))).select("commit_id")
    return L.introducing_commits(fixes, both)


@query(", t as (select commit_id, helper as line from messages where helper is not null union all select commit_id, review from messages where review is not null) select commit_id, lower(regexp_extract(line, '^([A-Za-z-]+):', 1)) as key, regexp_extract(line, ': (.*)$', 1) as value from t")
def trailer_values(h: History) -> DataFrame:
    rows = h.messages.select("commit_id", F.explode(C.trailers_of(F.col("message"))).alias("t"))
    return rows.select("commit_id", "t.key", "t.value")
