"""Queries on texts, search, question checks and drill state."""

from __future__ import annotations

from pyspark.sql import functions as F

from quizmill.functions import numbers, text
from quizmill.operators import bank, checks, drill, recommend, search
from quizmill.plans.registry import query
from quizmill.sources import tables

NORM = "trim(regexp_replace(regexp_replace(lower({}),'[^a-z0-9+ ]+',' ','g'),'\\s+',' ','g'))"
STOP = "[" + ",".join("'" + w.replace("'", "''") + "'" for w in text.SEARCH_STOP) + "]"
CHECK = "[" + ",".join(f"'{w}'" for w in text.CHECK_STOP) + "]"
CW = "list_distinct(list_filter(regexp_extract_all(lower({}),'[a-z0-9][a-z0-9+''.-]{{2,}}'), lambda w: NOT list_contains(" + CHECK + ", w)))"


@query(f"SELECT doc_id, md5(n) AS norm, len(list_filter(string_split(n,' '), lambda w: w<>'' AND NOT list_contains({STOP},w))) AS tokens FROM (SELECT doc_id, {NORM.format('text')} AS n FROM documents)")
def normal_texts(spark, d):
    docs = tables.table(spark, d, "documents").select("doc_id", text.norm(F.col("text")).alias("n"))
    return docs.select("doc_id", F.md5("n").alias("norm"), F.size(text.tokens_of(F.col("n"))).cast("long").alias("tokens"))


@query(f"WITH i AS (SELECT item_id, len(a) AS n, unnest(a) AS w FROM (SELECT item_id, {CW.format('text')} AS a FROM benchmark)), t AS (SELECT doc_id, unnest({CW.format('text')}) AS w FROM documents) SELECT item_id, doc_id, count(*)/CAST(any_value(n) AS DOUBLE) AS share FROM i JOIN t USING (w) GROUP BY 1,2")
def word_overlap(spark, d):
    """Every document against every item with which it shares a word."""
    docs = tables.table(spark, d, "documents").select(F.col("doc_id").alias("text"), text.check_words(F.col("text")).alias("words"))
    items = tables.table(spark, d, "benchmark").select(F.col("item_id").alias("item"), text.check_words(F.col("text")).alias("words"))
    return checks.meeting(docs, items).select(F.col("item").alias("item_id"), F.col("text").alias("doc_id"), "share")


def _apps(spark, d):
    k, t = F.col("p_partkey"), F.split("p_name", " ")
    return tables.table(spark, d, "part").select(F.concat(F.lit("app-"), F.lpad(k.cast("string"), 6, "0")).alias("slug"), F.col("p_name").alias("name"), F.col("p_brand").alias("exam"), F.col("p_type").alias("audience"), F.lit("live").alias("status"), F.array("p_brand").alias("covers"), F.concat(t, F.array(F.lower("p_type"))).alias("keywords"))


def _queries(spark, d):
    n = F.col("n_nationkey")
    return tables.table(spark, d, "nation").select(n.alias("query_id"), F.concat(F.lit("I want to study for the brand#"), (n % 5 + 1).cast("string"), (n % 3 + 1).cast("string"), F.lit(" exam")).alias("query"))


QN = "SELECT n_nationkey AS query_id, 'i want to study for the brand '||(n_nationkey%5+1)||(n_nationkey%3+1)||' exam' AS q, ['brand', (n_nationkey%5+1)||''||(n_nationkey%3+1)] AS words FROM nation"
AN = f"SELECT 'app-'||lpad(CAST(p_partkey AS VARCHAR),6,'0') AS slug, {NORM.format('p_brand')} AS cover, list_filter(list_transform(list_append(string_split(p_name,' '), lower(p_type)), lambda k: {NORM.format('k')}), lambda k: k<>'') AS keywords, {NORM.format('p_name||chr(32)||p_brand||chr(32)||p_type')} AS hay FROM part"
SCORE = f"SELECT query_id, slug, CAST(CASE WHEN cover<>'' AND (contains(q,cover) OR contains(cover,q)) THEN 60 ELSE 0 END + coalesce(list_sum(list_transform(keywords, lambda k: CASE WHEN contains(k,' ') THEN CASE WHEN contains(q,k) THEN 30 ELSE 0 END WHEN list_contains(words,k) THEN 18 WHEN length(k)>=5 AND len(list_filter(words, lambda w: length(w)>=5 AND (starts_with(w,k) OR starts_with(k,w))))>0 THEN 9 ELSE 0 END)),0) + coalesce(list_sum(list_transform(words, lambda w: CASE WHEN length(w)>=4 AND contains(hay,w) THEN 6 ELSE 0 END)),0) AS BIGINT) AS score FROM ({QN}) CROSS JOIN ({AN})"


FOUND = f"SELECT query_id, slug, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, slug) AS rank FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS top FROM ({SCORE}) WHERE score>0) WHERE score>=greatest(12, top*0.6)"


@query(FOUND)
def catalogue_search(spark, d):
    return search.search(_queries(spark, d), _apps(spark, d)).select("query_id", "slug", "score", "rank")


WHY = "list_filter(list_concat(CASE WHEN cover<>'' AND (contains(q,cover) OR contains(cover,q)) THEN [brand] ELSE [] END, list_transform(keywords, lambda k: CASE WHEN contains(k.n,' ') THEN CASE WHEN contains(q,k.n) THEN k.raw END WHEN list_contains(words,k.n) THEN k.raw WHEN length(k.n)>=5 AND len(list_filter(words, lambda w: length(w)>=5 AND (starts_with(w,k.n) OR starts_with(k.n,w))))>0 THEN k.raw END)), lambda x: x IS NOT NULL)"
AW = f"SELECT 'app-'||lpad(CAST(p_partkey AS VARCHAR),6,'0') AS slug, p_brand AS brand, {NORM.format('p_brand')} AS cover, list_filter(list_transform(list_append(string_split(p_name,' '), lower(p_type)), lambda k: {{'raw': k, 'n': {NORM.format('k')}}}), lambda k: k.n<>'') AS keywords FROM part"


@query(f"SELECT f.query_id, f.slug, array_to_string(w[1:4],'|') AS why FROM ({FOUND}) f JOIN (SELECT query_id, slug, list_filter(a, lambda x, i: list_position(a, x)=i) AS w FROM (SELECT query_id, slug, {WHY} AS a FROM ({QN}) CROSS JOIN ({AW}))) r ON r.query_id=f.query_id AND r.slug=f.slug")
def search_reasons(spark, d):
    """By what each candidate was found."""
    return search.reasons(_queries(spark, d), _apps(spark, d)).select("query_id", "slug", F.array_join("why", "|").alias("why"))


@query(f"WITH f AS ({FOUND}), n AS (SELECT query_id, count(DISTINCT slug) FILTER (WHERE slug IN ('app-000001','app-000002','app-000003')) AS n, max(slug) FILTER (WHERE rank=1) AS slug FROM f GROUP BY 1) SELECT n_nationkey AS query_id, CASE WHEN slug IS NULL THEN 'none' WHEN n>=2 THEN 'narrow' ELSE 'pick' END AS outcome, slug, CASE WHEN n>=2 THEN 'first' END AS decision FROM nation LEFT JOIN n ON n_nationkey=query_id")
def search_outcomes(spark, d):
    found = search.search(_queries(spark, d), _apps(spark, d))
    table = spark.createDataFrame([(1, "first", ["app-000001", "app-000002", "app-000003"], ["app-000001", "app-000003"])], "place int, decision string, among array<string>, options array<string>")
    return search.outcome(_queries(spark, d), found, table)


def _questions(spark, d):
    """A bank over the benchmark: four choices from an item's words, a rationale that names some of them."""
    w = F.filter(F.split(F.lower("text"), r"[^a-z]+"), lambda x: F.length(x) > 3)
    b = tables.table(spark, d, "benchmark").select(F.lit("demo").alias("slug"), F.col("item_id").alias("id"), w.alias("w")).where("size(w) >= 8")
    choice = lambda k: F.concat_ws(" ", F.get("w", F.lit(2 * k)), F.get("w", F.lit(2 * k + 1)))
    told = F.get(F.array(*(choice(k) for k in range(4))), (F.col("id") % 4).cast("int"))
    return b.select("slug", "id", F.array(*(choice(k) for k in range(4))).alias("choices"), F.when(F.col("id") % 3 == 0, (F.col("id") + 1) % 4).otherwise(F.col("id") % 4).alias("answer"), F.concat(told, F.lit(", "), F.initcap(told), F.lit(" ("), text.letter((F.col("id") + F.col("id") % 2) % 4), F.lit(") holds.")).alias("why"))


# The same bank in DuckDB's SQL: words, four choices, the answer, a rationale
LETTER = "substr('ABCD', CAST({}+1 AS INTEGER), 1)"
LETTERS = "list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: length(x)>3)"
QUESTIONS = f"SELECT id, choices, CASE WHEN id%3=0 THEN (id+1)%4 ELSE id%4 END AS answer, told||', '||array_to_string(list_transform(string_split(told,' '), lambda x: upper(x[1])||x[2:]),' ')||' ('||{LETTER.format('(id+id%2)%4')}||') holds.' AS why FROM (SELECT *, choices[id%4+1] AS told FROM (SELECT item_id AS id, [w[1]||' '||w[2], w[3]||' '||w[4], w[5]||' '||w[6], w[7]||' '||w[8]] AS choices FROM (SELECT item_id, {LETTERS} AS w FROM benchmark) WHERE len(w)>=8))"
SHARE = "CASE WHEN len({a})>0 THEN len(list_intersect({a},{b}))/CAST(len({a}) AS DOUBLE) ELSE 0.0::DOUBLE END"
LEAD = f"SELECT *, CASE WHEN regexp_matches(part,'\\.\\s') THEN regexp_extract(part,'(?s)^(.*?\\.)\\s',1) ELSE part END AS lead FROM (SELECT *, regexp_split_to_array(why,'\\([A-D]\\)')[1] AS part FROM ({QUESTIONS}))"
RATED = f"SELECT *, list_transform(cs, lambda c: {SHARE.format(a='c', b='lw')}) AS scores FROM (SELECT *, list_transform(choices, lambda c: {CW.format('c')}) AS cs, {CW.format('lead')} AS lw, {CW.format('why')} AS ww FROM ({LEAD}))"
MISKEYS = f"SELECT 'demo' AS slug, id, answer, best_at-1 AS says, id=3 AS dismissed FROM (SELECT *, list_max(scores) AS best, list_position(scores, list_max(scores)) AS best_at, scores[answer+1] AS in_lead, {SHARE.format(a='cs[answer+1]', b='ww')} AS anywhere FROM ({RATED})) WHERE best_at-1<>answer AND best>=0.6 AND best-in_lead>=0.5 AND anywhere<0.2 AND len(cs[best_at])>=2 AND NOT regexp_matches(trim(choices[best_at]),'(?i)^(no|none|not|never)\\b')"
NAMED = checks.NAMED.replace("'", "''")
CALLED = f"SELECT id, choices, unnest(regexp_extract_all(why,'{NAMED}',1)) AS name, unnest(regexp_extract_all(why,'{NAMED}',2)) AS sign FROM ({QUESTIONS})"
STALE = f"SELECT 'demo' AS slug, id, name, sign AS letter, {LETTER.format('(list_position(others, list_max(others))-1)')} AS belongs FROM (SELECT *, {SHARE.format(a='nw', b='cs[idx+1]')} AS here, list_transform(range(len(cs)), lambda i: CASE WHEN i=idx THEN -1.0::DOUBLE ELSE {SHARE.format(a='nw', b='cs[i+1]')} END) AS others FROM (SELECT *, {CW.format('name')} AS nw, ascii(sign)-65 AS idx, list_transform(choices, lambda c: {CW.format('c')}) AS cs FROM (SELECT id, choices, sign, trim(regexp_replace(name,'(?i)^(and|or|but|the|a|an|is|not)\\s+','')) AS name FROM ({CALLED})) WHERE len(regexp_split_to_array(name,'\\s+'))<=6)) WHERE here<0.5 AND list_max(others)>=0.5"


@query(MISKEYS)
def miskeyed_questions(spark, d):
    return checks.miskeys(_questions(spark, d), spark.createDataFrame([("demo", 3)], "slug string, id long"))


@query(STALE)
def stale_letters(spark, d):
    return checks.stale_letters(_questions(spark, d))


@query(f"SELECT (SELECT count(*) FROM ({QUESTIONS})) AS checked, (SELECT count(*) FROM ({MISKEYS}) WHERE NOT dismissed) AS miskeys, (SELECT count(*) FROM ({MISKEYS}) WHERE dismissed) AS dismissed, (SELECT count(*) FROM ({STALE})) AS stale")
def check_totals(spark, d):
    return checks.totals(_questions(spark, d), spark.createDataFrame([("demo", 3)], "slug string, id long"))


@query(f"SELECT id, len(choices)=4 AND answer IS NOT NULL AS gradable, id%5=0 AS ungraded FROM (SELECT id, choices, CASE WHEN id%5=0 THEN NULL ELSE answer END AS answer, why FROM ({QUESTIONS}))")
def gradable_questions(spark, d):
    """Which questions a check takes, and which wait for grading."""
    rows = _questions(spark, d).withColumn("answer", F.when(F.col("id") % 5 != 0, F.col("answer")))
    good = bank.gradable(rows).select(F.col("id").alias("_id"))
    return rows.join(good, F.col("id") == F.col("_id"), "left").select("id", F.col("_id").isNotNull().alias("gradable"), bank.needs_grading(F.col("answer")).alias("ungraded"))


@query(f"SELECT id, lead, regexp_matches(trim(choices[1]),'(?i)^(no|none|not|never)\\b') AS negated, regexp_replace(lead||chr(10)||'  '||why,'\\s*\\n\\s*',' ','g') AS folded, 'Licensed to '||choices[1]||' · '||substr(choices[2],1,8)||' · 2026-01-01 · Mill' AS mark, ((id+id%2)%4) AS idx, 'm[a]='||id||CASE WHEN id%2=0 THEN ',m[b]=x' ELSE '' END AS flat FROM ({LEAD})")
def text_pieces(spark, d):
    """Small functions on texts: lead clause, negation, folded lines, watermark, letters, flattened fields."""
    q, k = _questions(spark, d), F.col("id")
    lead, first = text.lead_clause(F.col("why")), F.get("choices", F.lit(0))
    flat = text.flattened("m", {"a": k, "b": F.when(k % 2 == 0, F.lit("x"))})
    told = F.array_join(F.transform(F.array_sort(F.map_entries(flat)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return q.select("id", lead.alias("lead"), text.negated(first).alias("negated"), text.fold_lines(F.concat(lead, F.lit("\n  "), "why")).alias("folded"), text.watermark(first, F.get("choices", F.lit(1)), F.lit("2026-01-01"), "Mill").alias("mark"), text.letter_index(text.letter((k + k % 2) % 4)).cast("long").alias("idx"), told.alias("flat"))


@query("SELECT p_partkey AS id, 'T'||lpad(CAST(p_partkey AS VARCHAR), CAST(greatest(3, length(CAST(p_partkey AS VARCHAR))) AS INTEGER), '0') AS old, regexp_matches(p_name||' '||p_size||' Terms', '(?i)\\b\\d+\\s+(terms|scenarios|vignettes|questions)\\b') AS counts, replace(replace(replace(replace(p_name||'<&\">','&','&amp;'),'<','&lt;'),'>','&gt;'),'\"','&quot;') AS html, 'ebook_'||translate(p_brand,'-','_') AS price_key, substr('ABCD', CAST(p_partkey%4+1 AS INTEGER), 1) AS letter, (p_size//60)||':'||lpad(CAST(p_size%60 AS VARCHAR),2,'0') AS clock, '$'||(p_size*37//100)||'.'||lpad(CAST(p_size*37%100 AS VARCHAR),2,'0') AS money FROM part")
def text_functions(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size")
    return tables.table(spark, d, "part").select(k.alias("id"), text.numbered("T", k).alias("old"), text.repeats_counts(F.concat_ws(" ", "p_name", "p_size", F.lit("Terms"))).alias("counts"), text.escape_html(F.concat("p_name", F.lit('<&">'))).alias("html"), text.price_key("ebook", F.col("p_brand")).alias("price_key"), text.letter(k % 4).alias("letter"), numbers.clock(size).alias("clock"), numbers.money(size * 37).alias("money"))


def _drill(spark, d):
    return tables.plan_events(spark, d).select("id", "user_id", "item_id", "score", "ts")


@query("SELECT user_id, item_id, CAST(list_reduce(list_prepend(0, list(score ORDER BY ts, id)), lambda b, s: CASE s WHEN 2 THEN least(b+1,3) WHEN 1 THEN b ELSE 0 END) AS BIGINT) AS box, max(ts) AS at FROM plan_events GROUP BY 1,2", "plan_events")
def leitner_boxes(spark, d):
    return drill.boxes(_drill(spark, d), "user_id", "item_id")


@query('SELECT user_id, item_id, count(*) AS seen, count(*) FILTER (WHERE score=2) AS "right" FROM plan_events GROUP BY 1,2', "plan_events")
def scenario_counters(spark, d):
    return drill.counters(_drill(spark, d), "user_id", "item_id")


@query("SELECT user_id, item_id, arg_max(CASE WHEN score>0 THEN 'known' ELSE 'again' END, (ts,id)) AS mark FROM plan_events GROUP BY 1,2", "plan_events")
def flashcard_marks(spark, d):
    return drill.marks(_drill(spark, d), "user_id", "item_id")


BOX = "bx AS (SELECT user_id, item_id, list_reduce(list_prepend(0, list(score ORDER BY ts, id)), lambda b, s: CASE s WHEN 2 THEN least(b+1,3) WHEN 1 THEN b ELSE 0 END) AS box, max(ts) AS at, arg_max(score,(ts,id))>0 AS known, count(*) FILTER (WHERE score=2)/CAST(count(*) AS DOUBLE) AS acc FROM plan_events GROUP BY 1,2)"


def _terms(spark, d):
    return _drill(spark, d).select("item_id").distinct().withColumn("section", F.substring("item_id", -1, 1))


@query(f"WITH {BOX}, n AS (SELECT right(item_id,1) AS section, count(DISTINCT item_id) AS n FROM plan_events GROUP BY 1) SELECT user_id, section, CAST(floor(k*100.0::DOUBLE/n+0.5) AS BIGINT) AS known_pct, CAST(floor(s*100.0::DOUBLE/n+0.5) AS BIGINT) AS said_pct, round(a,9) AS accuracy, CAST(floor((k+s)*100.0::DOUBLE/(2*n)+0.5) AS BIGINT) AS mastery FROM (SELECT user_id, right(item_id,1) AS section, count(*) FILTER (WHERE known) AS k, count(*) FILTER (WHERE box>=2) AS s, avg(acc) AS a FROM bx GROUP BY 1,2) JOIN n USING (section)", "plan_events")
def section_progress(spark, d):
    e = _drill(spark, d)
    keys = ("user_id", "item_id")
    return drill.section_progress(_terms(spark, d), drill.boxes(e, *keys), drill.marks(e, *keys), drill.counters(e, *keys))


@query(f"WITH {BOX} SELECT user_id, count(*)/100.0::DOUBLE AS mastered FROM bx WHERE known OR box>=2 GROUP BY 1", "plan_events")
def mastery_ruler(spark, d):
    e = _drill(spark, d)
    return drill.ruler(drill.boxes(e, "user_id", "item_id"), drill.marks(e, "user_id", "item_id"), 100)


@query(f'WITH {BOX} SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY box, "at", item_id) AS rank FROM bx', "plan_events")
def review_queue(spark, d):
    return drill.review_queue(drill.boxes(_drill(spark, d), "user_id", "item_id").withColumn("place", F.col("item_id"))).select("user_id", "item_id", "rank")


@query("SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY md5(item_id||':5'), item_id) AS place FROM (SELECT DISTINCT user_id, item_id FROM plan_events)", "plan_events")
def flashcard_queue(spark, d):
    """Each user's cards in an order that a seed fixes; what is known and what isn't are shuffled together."""
    from pyspark.sql.window import Window

    cards = recommend.shuffled(_drill(spark, d).select("user_id", "item_id").distinct(), 5, "item_id")
    return cards.select("user_id", "item_id", F.row_number().over(Window.partitionBy("user_id").orderBy("shuffle_key", "item_id")).cast("long").alias("place"))
