"""Queries on question banks."""

from __future__ import annotations

from pyspark.sql import functions as F

from quizmill.operators import bank
from quizmill.plans.registry import query
from quizmill.sources import tables


@query("SELECT id, n, cat, stem FROM bank", "bank")
def public_bank(spark, d):
    return bank.public_form(tables.bank(spark, d))


@query("SELECT a.session_id, a.id, a.picked, b.answer, a.picked=b.answer AS correct FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY id) AS k FROM answers) a JOIN bank b USING (id) WHERE k<=500", "answers bank")
def graded_answers(spark, d):
    return bank.graded(tables.answers(spark, d), tables.bank(spark, d), "session_id")


@query("SELECT id, n, cat, stem FROM bank WHERE id IN (SELECT r_regionkey*7+k FROM region, generate_series(1,3) t(k))", "bank")
def fetched_questions(spark, d):
    asked = tables.table(spark, d, "region").select(F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda k: (F.col("r_regionkey") * 7 + k).cast("long")).alias("ids"))
    return bank.fetched(tables.bank(spark, d), asked)


def _two(spark, d):
    b = tables.bank(spark, d)
    old = b.where("id % 3 <> 0").select("id", F.when(F.col("id") % 2 == 0, F.col("cat")).alias("cat"), "answer")
    new = b.where("id % 3 <> 1").select("id", F.upper("cat").alias("cat"))
    return old, new


TWO = "o AS (SELECT id, CASE WHEN id%2=0 THEN cat END AS cat, answer FROM bank WHERE id%3<>0), w AS (SELECT id, upper(cat) AS cat FROM bank WHERE id%3<>1)"


@query(f"WITH {TWO} SELECT coalesce(o.id,w.id) AS id, coalesce(o.cat,w.cat) AS cat, o.answer FROM o FULL JOIN w ON o.id=w.id", "bank")
def merged_bank(spark, d):
    return bank.merged(*_two(spark, d))


@query(f"WITH {TWO} SELECT coalesce(o.id,w.id) AS id, coalesce(w.cat,o.cat) AS cat, o.answer FROM o FULL JOIN w ON o.id=w.id", "bank")
def merged_cache(spark, d):
    return bank.merged(*_two(spark, d), existing_wins=False)


@query("SELECT id, CASE WHEN id%2=0 THEN answer ELSE CASE WHEN id%5<>0 THEN answer END END AS answer, CASE WHEN id%5<>0 AND id%7<>0 THEN 'because '||id ELSE 'local' END AS why, CASE WHEN id%5<>0 THEN sub ELSE cat END AS label FROM bank", "bank")
def patched_grades(spark, d):
    b = tables.bank(spark, d)
    local = b.select("id", F.when(F.col("id") % 2 == 0, F.col("answer")).alias("answer"), F.lit("local").alias("why"), F.col("cat").alias("label"))
    back = b.where("id % 5 <> 0").select("id", "answer", F.when(F.col("id") % 7 != 0, F.concat(F.lit("because "), F.col("id").cast("string"))).alias("why"), F.col("sub").alias("label"))
    return bank.patched(local, back)


@query("SELECT s.id AS place, s.id, CASE WHEN b.id IS NULL THEN 'missing' WHEN s.cat=b.cat AND s.answer=b.answer THEN 'same' ELSE 'changed' END AS state, coalesce(b.cat,s.cat) AS cat, coalesce(b.answer,s.answer) AS answer FROM (SELECT id, CASE WHEN id%4=0 THEN 'old' ELSE cat END AS cat, answer FROM bank WHERE id%2=0) s LEFT JOIN (SELECT * FROM bank WHERE id%10<>0) b ON s.id=b.id", "bank")
def refreshed_sample(spark, d):
    b = tables.bank(spark, d).select("id", "cat", "answer")
    sample = b.where("id % 2 = 0").select(F.col("id").alias("place"), "id", F.when(F.col("id") % 4 == 0, "old").otherwise(F.col("cat")).alias("cat"), "answer")
    return bank.refreshed(sample, b.where("id % 10 <> 0"))


@query("SELECT n_nationkey AS k, 'q'||CAST((SELECT max(id) FROM bank)+n_nationkey+1 AS VARCHAR) AS new_id FROM nation", "bank")
def numbered_questions(spark, d):
    return bank.numbered(tables.table(spark, d, "nation").select(F.col("n_nationkey").alias("k")), tables.bank(spark, d), "q", "k")


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_orderkey, l_linenumber) AS place FROM lineitem")
def placed_lines(spark, d):
    """The place of every line in the order of all, without a task that holds them all."""
    lines = tables.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    return bank.placed(lines, "place", "l_orderkey", "l_linenumber")


@query("SELECT c_custkey AS k, c_nationkey AS term, CASE WHEN c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_suppkey<=5) THEN 'exists' ELSE 'repeated' END AS reason FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS nth FROM customer) WHERE nth>1 OR c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_suppkey<=5)")
def duplicate_terms(spark, d):
    """All customers' nations against terms in use: those of five suppliers, so that some are in use and some are not."""
    new = tables.table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("term"))
    return bank.duplicates(new, tables.table(spark, d, "supplier").where("s_suppkey <= 5").select(F.col("s_nationkey").alias("term")), "term", "k")


@query("SELECT o_orderkey AS n, CASE WHEN o_orderkey%6=0 THEN NULL ELSE o_orderkey%4 END AS answer, CASE WHEN o_orderkey%6=0 THEN 'no answer' END AS problem FROM orders")
def unanswered_scenarios(spark, d):
    rows = tables.table(spark, d, "orders").select(F.col("o_orderkey").alias("n"))
    return bank.answered(rows, rows.where("n % 6 <> 0").select("n", (F.col("n") % 4).alias("answer")))


@query("SELECT id, id IN (SELECT l_partkey FROM lineitem WHERE l_orderkey<50) AS free FROM bank", "bank")
def free_questions(spark, d):
    """All questions; the free ones are the parts of some first orders, so that both kinds occur."""
    free = tables.table(spark, d, "lineitem").where("l_orderkey < 50").select(F.col("l_partkey").alias("id"))
    return bank.free_flags(tables.bank(spark, d), free).select("id", "free")


@query("SELECT id, cat, min(id) OVER w AS section_at, row_number() OVER (PARTITION BY cat ORDER BY id) AS i, count(*) OVER w AS of FROM bank WINDOW w AS (PARTITION BY cat)", "bank")
def bank_sections(spark, d):
    return bank.in_sections(tables.bank(spark, d).select("id", "cat"), "cat", "id")


@query("SELECT 'app-'||n||'-'||cat AS slug, count(*) AS total, count(*) FILTER (WHERE id%10=0) AS free, string_agg(id||':'||answer, ',' ORDER BY id) AS keys FROM bank GROUP BY 1", "bank")
def split_bank(spark, d):
    """Every app's bank as a document, in which one question in ten is free."""
    b = tables.bank(spark, d)
    found = bank.split_bank(b, b.where("id % 10 = 0"), F.concat_ws("-", F.lit("app"), "n", "cat"))
    keys = F.transform(F.from_json("questions", "array<struct<id:long,answer:long>>"), lambda q: F.concat_ws(":", q["id"], q["answer"]))
    return found.select("slug", "total", F.size(F.from_json("freeIds", "array<long>")).cast("long").alias("free"), F.array_join(keys, ",").alias("keys"))


@query("SELECT s_suppkey AS slug, s_suppkey*4 AS terms, s_suppkey%250 AS questions, CASE WHEN s_suppkey%9<>0 THEN s_suppkey*4+(s_suppkey%3) END AS found_terms, CASE WHEN s_suppkey%9<>0 THEN s_suppkey%250 END AS found_questions FROM supplier WHERE s_suppkey%9=0 OR s_suppkey%3<>0")
def count_drift(spark, d):
    k = F.col("s_suppkey")
    s = tables.table(spark, d, "supplier")
    return bank.count_drift(s.select(k.alias("slug"), (k * 4).alias("terms"), (k % 250).alias("questions")), s.where("s_suppkey % 9 <> 0").select(k.alias("slug"), (k * 4 + k % 3).alias("terms"), (k % 250).alias("questions")))


@query("SELECT id, cat FROM bank WHERE cat=(SELECT min(cat) FROM bank)", "bank")
def section_view(spark, d):
    b = tables.bank(spark, d)
    first = b.agg(F.min("cat").alias("_c"))
    return b.crossJoin(F.broadcast(first)).where(bank.section_filter("cat", F.col("_c"))).select("id", "cat")  # one row


@query("SELECT c_nationkey AS exam, count(DISTINCT c_mktsegment) AS apps FROM customer GROUP BY 1 HAVING count(DISTINCT c_mktsegment)>1")
def shared_exam_names(spark, d):
    c = tables.table(spark, d, "customer").select(F.col("c_nationkey").alias("exam"), "c_mktsegment").distinct()
    return c.groupBy("exam").agg(F.count("*").alias("apps")).where("apps > 1")
