"""The driver's star-schema tables presented as one repository's history: as DataFrames, and as SQL views for DuckDB.

Only this module knows both sides. Order keys are commits, order lines (summed by order and part) are changes, parts are files,
customers are people; documents give message texts. Ids are keys plus one.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUBJECTS = {"1-URGENT": "fix: ", "2-HIGH": "feat: ", "3-MEDIUM": "refactor: ", "4-NOT SPECIFIED": "Revert ", "5-LOW": "chore: "}
#: White space as Java patterns have it.
WHITE = " \t\n\x0b\f\r"

#: Paths by p_partkey % 20; {k} is the key. The rest are source files of five languages.
PATHS = {0: "dist/bundle/f{k}.js", 1: "vendor/lib/f{k}.go", 2: "pkg{k}/package-lock.json", 3: "pkg{k}/Cargo.toml", 4: "src/core/{k}/index.ts", 5: "tests/unit/test_{k}.py", 6: "assets/img{k}.png", 7: "README{k}.md"}
EXTENSIONS = ["rs", "py", "ts", "go", "java"]


class History:
    """Model tables of a data directory, each read once and pruned by what a query uses."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def commits(self) -> DataFrame:
        """commit_id, author_id, authored_at, committed_at, pri; without texts."""
        at = F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
        return self.table("orders").select((F.col("o_orderkey") + 1).alias("commit_id"), (F.col("o_custkey") + 1).alias("author_id"), at.alias("authored_at"), at.alias("committed_at"), F.col("o_orderpriority").alias("pri"))

    @cached_property
    def messages(self) -> DataFrame:
        """All commits as ``told``."""
        return self.told(self.commits)

    def told(self, commits: DataFrame, few: bool = False) -> DataFrame:
        """commits with message, subject, has_body, n_trailers; of few commits only their texts are read on.

        A subject is a prefix and a text's whole first line, a body the whole rest of it; bodies stand in the first of three rounds through
        the texts. Texts are taken apart once, before they meet their commits.
        """
        text = F.coalesce("text", F.lit(""))
        feed = F.instr(text, "\n")
        rest = F.when(feed > 0, F.trim(F.substr(text, feed + 1), F.lit(WHITE))).otherwise("")
        docs = self.table("documents").select("doc_id", F.trim(F.substring_index(text, "\n", 1)).alias("head"), rest.alias("rest"), (rest != "").alias("has_rest"))
        n = self.table("documents").agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("n_docs"))
        key = F.col("commit_id") - 1
        rows = commits.crossJoin(F.broadcast(n)).withColumn("doc_id", key % F.col("n_docs")).withColumn("told", F.floor(key / F.col("n_docs")) % 3 == 0).drop("n_docs")
        if few:
            docs = docs.join(F.broadcast(rows.select("doc_id").distinct()), "doc_id", "left_semi")
        # Both sides shuffle: a broadcast would leave the work on texts to the few tasks that read the small side's file.
        rows = rows.join(docs.hint("merge"), "doc_id", "left")
        head, has_body = F.coalesce("head", F.lit("")), F.col("told") & F.coalesce("has_rest", F.lit(False))
        prefix = F.element_at(F.create_map(*[F.lit(x) for p in SUBJECTS.items() for x in p]), F.col("pri"))
        number = key.cast("string")
        subject = F.when(key % 13 == 0, "update").when(key % 17 == 0, "chore: run formatter").when(key % 19 == 0, F.concat(F.lit("Reland "), head)).when(key % 23 == 0, F.concat(F.lit("Merge pull request #"), number, F.lit(" from topic"))).otherwise(F.concat(prefix, head))
        subject = F.trim(F.concat(subject, F.when(key % 7 == 0, F.concat(F.lit(" (#"), number, F.lit(")"))).otherwise("")))
        person = (key % 97).cast("string")
        helper = F.when(key % 5 == 0, F.concat(F.lit("Co-authored-by: Helper "), person, F.lit(" <helper"), person, F.lit("@example.org>")))
        review = F.when(key % 29 == 1, F.concat(F.lit("Change-Id: I"), F.sha1(number))).when(key % 29 == 2, F.concat(F.lit("PR-URL: https://example.org/r/pull/"), number))
        trailer = F.concat_ws("\n", helper, review)
        message = F.concat(subject, F.when(has_body, F.concat(F.lit("\n\n"), F.col("rest"))).otherwise(""), F.when(trailer != "", F.concat(F.lit("\n\n"), trailer)).otherwise(""))
        n_trailers = helper.isNotNull().cast("int") + review.isNotNull().cast("int")
        return rows.select("commit_id", "author_id", "authored_at", "committed_at", message.alias("message"), subject.alias("subject"), has_body.alias("has_body"), n_trailers.alias("n_trailers"))

    @cached_property
    def parents(self) -> DataFrame:
        child = self.table("orders").select((F.col("o_orderkey") + 1).alias("child_id"))
        first = child.where("child_id > 1").select("child_id", (F.col("child_id") - 1).alias("parent_id"), F.lit(0).alias("ordinal"))
        second = child.where("child_id > 7 and (child_id - 1) % 11 = 0").select("child_id", (F.col("child_id") - 7).alias("parent_id"), F.lit(1).alias("ordinal"))
        return first.unionByName(second)

    @cached_property
    def people(self) -> DataFrame:
        rows = self.table("customer").join(F.broadcast(self.table("nation").select("n_nationkey", "n_name")), F.col("c_nationkey") == F.col("n_nationkey"))
        email = F.concat(F.lit("Customer"), F.col("c_custkey").cast("string"), F.lit("+dev@"), F.regexp_replace("n_name", " ", "-"), F.lit(".example"))
        return rows.select((F.col("c_custkey") + 1).alias("person_id"), F.col("c_name").alias("name"), email.alias("email"), (F.col("c_mktsegment") == "MACHINERY").alias("is_bot"))

    @cached_property
    def files(self) -> DataFrame:
        key = F.col("p_partkey").cast("string")
        kind = F.col("p_partkey") % 20
        ext = F.get(F.array(*[F.lit(e) for e in EXTENSIONS]), (F.col("p_partkey") % 5).cast("int"))
        path = F.concat(F.lit("src/m"), (F.col("p_partkey") % 11).cast("string"), F.lit("/file"), key, F.lit("."), ext)
        for k, form in PATHS.items():
            before, _, after = form.partition("{k}")
            path = F.when(kind == k, F.concat(F.lit(before), key, F.lit(after))).otherwise(path)
        return self.table("part").select((F.col("p_partkey") + 1).alias("file_id"), path.alias("path"), (F.col("p_size") <= 45).alias("alive"))

    @cached_property
    def changes(self) -> DataFrame:
        return self.table("lineitem").groupBy((F.col("l_orderkey") + 1).alias("commit_id"), (F.col("l_partkey") + 1).alias("file_id")).agg(
            F.sum("l_quantity").cast("long").alias("insertions"), F.sum("l_linenumber").cast("long").alias("deletions"), F.bool_or(F.col("l_returnflag") == "R").alias("is_binary")
        )

    @cached_property
    def hunks(self) -> DataFrame:
        return self.table("lineitem").select(
            (F.col("l_orderkey") + 1).alias("commit_id"), (F.col("l_partkey") + 1).alias("file_id"), (1 + F.col("l_linenumber") * 10).cast("long").alias("new_start"),
            F.col("l_quantity").cast("long").alias("new_len"), F.when(F.col("l_discount") < 0.06, 1).otherwise(0).alias("kind"),
        )

    @cached_property
    def tags(self) -> DataFrame:
        key = F.col("o_orderkey")
        name = F.when(key % 100 == 0, F.concat(F.lit("v"), key.cast("string"))).when(key % 150 == 0, F.concat(F.lit("release-"), key.cast("string"))).otherwise(F.concat(F.lit("1."), key.cast("string")))
        rows = self.table("orders").where("o_orderkey % 50 = 0")
        return rows.select((key + 1).alias("tag_id"), name.alias("name"), (key + 1).alias("target_id"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("tagged_at"))

    @cached_property
    def aliases(self) -> DataFrame:
        """Two aliases of each file: an old path up to a commit, the present path from it on."""
        cut = (F.col("file_id") * 7) % 1000 + 1
        old = self.files.select("file_id", F.concat(F.lit("old/"), F.col("path")).alias("path"), F.lit(1).cast("long").alias("from_commit"), cut.alias("to_commit"))
        return old.unionByName(self.files.select("file_id", "path", cut.alias("from_commit"), F.lit(None).cast("long").alias("to_commit")))

    @cached_property
    def now(self) -> int:
        """The latest commit's time: never the clock."""
        return self.commits.agg(F.max("authored_at")).first()[0] or 0


def _sql_case(form: dict) -> str:
    return " ".join(f"when {k} then '{f.partition('{k}')[0]}' || p_partkey || '{f.partition('{k}')[2]}'" for k, f in form.items())


SQL = f"""
with commits as (select o_orderkey + 1 as commit_id, o_custkey + 1 as author_id, cast(epoch(o_orderdate) as bigint) as authored_at, cast(epoch(o_orderdate) as bigint) as committed_at, o_orderpriority as pri from orders),
ndocs as (select greatest(count(*), 1) as n from documents),
msg0 as (select c.*, commit_id - 1 as k, coalesce(d.text, '') as text, ((c.commit_id - 1) // ndocs.n) % 3 = 0 as told from commits c cross join ndocs left join documents d on d.doc_id = (c.commit_id - 1) % ndocs.n),
msg1 as (select *, trim(split_part(text, chr(10), 1)) as head, case when told and contains(text, chr(10)) then trim(substr(text, strpos(text, chr(10)) + 1), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) else '' end as body from msg0),
msg2 as (select *, trim(case when k % 13 = 0 then 'update' when k % 17 = 0 then 'chore: run formatter' when k % 19 = 0 then 'Reland ' || head when k % 23 = 0 then 'Merge pull request #' || k || ' from topic'
           else case pri {' '.join(f"when '{p}' then '{s}'" for p, s in SUBJECTS.items())} end || head end || case when k % 7 = 0 then ' (#' || k || ')' else '' end) as subject,
         case when k % 5 = 0 then 'Co-authored-by: Helper ' || (k % 97) || ' <helper' || (k % 97) || '@example.org>' end as helper,
         case when k % 29 = 1 then 'Change-Id: I' || sha1(k::varchar) when k % 29 = 2 then 'PR-URL: https://example.org/r/pull/' || k end as review from msg1),
msg3 as (select *, concat_ws(chr(10), helper, review) as trailer from msg2),
messages as (select commit_id, author_id, authored_at, committed_at, subject || case when body <> '' then chr(10) || chr(10) || body else '' end || case when trailer <> '' then chr(10) || chr(10) || trailer else '' end as message,
         subject, body, helper, review, body <> '' as has_body, (case when helper is not null then 1 else 0 end) + (case when review is not null then 1 else 0 end) as n_trailers from msg3),
parents as (select commit_id as child_id, commit_id - 1 as parent_id, 0 as ordinal from commits where commit_id > 1
         union all select commit_id, commit_id - 7, 1 from commits where commit_id > 7 and (commit_id - 1) % 11 = 0),
people as (select c_custkey + 1 as person_id, c_name as name, 'Customer' || c_custkey || '+dev@' || replace(n_name, ' ', '-') || '.example' as email, c_mktsegment = 'MACHINERY' as is_bot
         from customer join nation on c_nationkey = n_nationkey),
files as (select p_partkey + 1 as file_id, case p_partkey % 20 {_sql_case(PATHS)}
         else 'src/m' || (p_partkey % 11) || '/file' || p_partkey || '.' || ['{"','".replace('"', "'").join(EXTENSIONS)}'][(p_partkey % 5) + 1] end as path, p_size <= 45 as alive, p_partkey % 20 as m from part),
changes as (select l_orderkey + 1 as commit_id, l_partkey + 1 as file_id, cast(sum(l_quantity) as bigint) as insertions, cast(sum(l_linenumber) as bigint) as deletions, bool_or(l_returnflag = 'R') as is_binary from lineitem group by all),
hunks as (select l_orderkey + 1 as commit_id, l_partkey + 1 as file_id, cast(1 + l_linenumber * 10 as bigint) as new_start, cast(l_quantity as bigint) as new_len, case when l_discount < 0.06 then 1 else 0 end as kind from lineitem),
tags as (select o_orderkey + 1 as tag_id, case when o_orderkey % 100 = 0 then 'v' || o_orderkey when o_orderkey % 150 = 0 then 'release-' || o_orderkey else '1.' || o_orderkey end as name, o_orderkey + 1 as target_id,
         cast(epoch(o_orderdate) as bigint) as tagged_at from orders where o_orderkey % 50 = 0),
aliases as (select file_id, 'old/' || path as path, 1 as from_commit, (file_id * 7) % 1000 + 1 as to_commit from files union all select file_id, path, (file_id * 7) % 1000 + 1, null from files),
now as (select max(authored_at) as t from commits),
source as (select x.commit_id, x.file_id, c.author_id, c.authored_at, case when x.is_binary then 0 else x.insertions + x.deletions end as churn from changes x join commits c using (commit_id) join files f using (file_id) where f.m not in (0, 1, 2)),
knowledge as (select file_id, author_id as person_id, sum(sqrt(cast(churn as double))) as accumulated, max(authored_at) as last_at, count(*) as commits from source group by all),
own_v as (select k.file_id, k.person_id, k.accumulated * exp(-(greatest(0, now.t - k.last_at) / 86400e0) / 365e0) as v from knowledge k, now where k.person_id not in (select person_id from people where is_bot)),
own_r as (select file_id, person_id, v / sum(v) over f as p, sum(v) over (partition by file_id order by v desc, person_id rows unbounded preceding) / sum(v) over f as held, row_number() over (partition by file_id order by v desc, person_id) as rn
         from own_v where v > 0 window f as (partition by file_id)),
ownership as (select file_id, max(case when rn = 1 then person_id end) as top_person, max(case when rn = 1 then p end) as top_share, min(case when held >= 0.5e0 - 1e-12 then rn end) as bus_factor, -sum(p * log2(p)) as entropy, count(*) as contributors from own_r group by file_id),
seen as (select author_id as person_id, max(authored_at) as last_seen from commits group by all),
isl as (select o.*, coalesce(bus_factor = 1 and (now.t - s.last_seen) / 86400e0 > 183, false) as is_island from ownership o left join seen s on s.person_id = o.top_person, now),
hot0 as (select s.file_id, sum(churn) as churn, count(*) as changes, avg(case when regexp_matches(trim(m.subject), '(?i)^(?:fix|bugfix|hotfix|patch)\\b|^fix[(:]|\\bfix(?:es|ed)\\b|\\bbug\\b|\\bregression\\b|\\bcrash\\b|\\bhotfix\\b') then 1e0 else 0e0 end) as fix_density,
         max(s.authored_at) as last_at, max(churn) as peak from source s join messages m using (commit_id) group by s.file_id having count(*) >= 2),
hotspots as (select h.*, (ln(1 + churn) / ln(1 + (select max(churn) from hot0))) * (ln(1 + peak) / ln(1 + (select max(peak) from hot0))) * exp(-((now.t - last_at) / 86400e0) * ln(2e0) / 365e0) * (1 + fix_density) as score from hot0 h, now)
"""
