"""Queries on content files. Each writes its files from the tables to the shared folder and reads them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from quizmill.operators import bank
from quizmill.plans.registry import query
from quizmill.sources import documents, tables
from quizmill.sources.places import folder


def _written(rows, name):
    """One text file for each row, in a folder of its own. rows: file, value."""
    path = folder(rows.sparkSession, name)
    rows.select("file", "value").repartition("file").write.partitionBy("file").text(path)
    return path


def _joined(*parts):
    """Lines of a group's rows, one row after the other in the order of the first."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*parts))), lambda x: x["line"]), "")


def _line(*parts):
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts)).alias("line")


@query("SELECT 3 AS planned, 'app-'||s_suppkey AS slug, CASE WHEN s_suppkey%2=0 THEN s_name END AS name, CAST(s_suppkey*4 AS INTEGER) AS terms, CASE WHEN s_suppkey%3=0 THEN s_nationkey||'' END AS covers FROM supplier")
def catalogue_file(spark, d):
    """The catalogue as a document for each nation; fields may be absent."""
    k = F.col("s_suppkey")
    app = F.struct(F.concat(F.lit("app-"), k).alias("slug"), F.when(k % 2 == 0, F.col("s_name")).alias("name"), (k * 4).alias("terms"), F.when(k % 3 == 0, F.struct(F.array(F.col("s_nationkey").cast("string")).alias("covers"))).alias("coach"))
    whole = tables.table(spark, d, "supplier").groupBy("s_nationkey").agg(F.collect_list(app).alias("apps")).select(F.col("s_nationkey").alias("file"), F.to_json(F.struct(F.lit(3).alias("planned"), "apps")).alias("value"))
    found = documents.registry(spark, _written(whole, "catalogue") + "/file=*")
    return found.select("planned", "slug", "name", "terms", F.get("coach.covers", F.lit(0)).alias("covers"))


@query("SELECT c_nationkey||'' AS app, 'c'||c_custkey AS id, c_name AS term, count(*) OVER (PARTITION BY c_nationkey) AS total FROM customer WHERE c_nationkey%5<>0")
def bundle_cards(spark, d):
    """Cards of bundles; a fifth of the files are no bundles and drop out."""
    n = F.col("c_nationkey")
    cards = F.collect_list(F.struct(F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_name").alias("term"), n.cast("string").alias("cat")))
    rows = tables.table(spark, d, "customer").groupBy("c_nationkey").agg(cards.alias("cards"))
    body = F.to_json(F.struct("cards", F.struct(F.size("cards").alias("total"), F.lit(True).alias("split")).alias("meta")))
    rows = rows.select(n.alias("file"), F.concat(F.when(n % 5 == 0, "window.OTHER = ").otherwise("window.DATA = "), body, F.lit(";")).alias("value"))
    return documents.bundle(spark, _written(rows, "bundles") + "/file=*").select(F.explode("cards").alias("card"), F.col("meta.total").cast("long").alias("total")).select(F.col("card.cat").alias("app"), "card.id", "card.term", "total")


BANKS = "SELECT 'app-'||p_size AS slug, count(*) OVER (PARTITION BY p_size) AS total, 'q'||p_partkey AS id, CAST(p_partkey%4 AS INTEGER) AS answer FROM part"


def _banks(spark, d):
    """Banks by size of part, and a file that is none, which is in the way."""
    k, path = F.col("p_partkey"), folder(spark, "banks")
    documents.write_banks(tables.table(spark, d, "part").select(F.concat(F.lit("app-"), "p_size").alias("slug"), F.concat(F.lit("q"), k).alias("id"), (k % 4).alias("answer")), path)
    broken = spark.range(1).select(F.lit("{no bank").alias("value"))
    broken.write.mode("append").text(f"{path}/file=broken")
    return path


@query(BANKS)
def bank_files(spark, d):
    rows = documents.BankCache(spark, _banks(spark, d)).get(0)
    return rows.select("slug", F.col("total").cast("long").alias("total"), F.explode("questions").alias("q")).select("slug", "total", "q.id", "q.answer")


@query("SELECT 'app-'||s_suppkey AS slug, CASE WHEN s_suppkey IN (SELECT p_size FROM part) THEN (SELECT count(*) FROM part WHERE p_size=s_suppkey) ELSE 1 END AS questions FROM supplier")
def bank_or_sample(spark, d):
    """How many questions each app has: of its bank, else of the sample in its bundle."""
    slug = F.concat(F.lit("app-"), "s_suppkey").alias("slug")
    apps = tables.table(spark, d, "supplier").select(slug)
    banks = documents.banks(spark, _banks(spark, d)).select("slug", F.transform("questions", lambda q: q["id"]).alias("questions"))
    samples = tables.table(spark, d, "supplier").select(slug, F.array("s_name").alias("questions"))
    return documents.bank_or_sample(apps, banks, samples).select("slug", F.size("questions").cast("long").alias("questions"))


@query("SELECT 'app-'||p_size AS slug, 'q'||p_partkey AS id, CAST(p_partkey%4 AS INTEGER) AS answer FROM part WHERE p_size=7 UNION ALL SELECT 'app-0', s_name, NULL FROM supplier WHERE s_suppkey=0")
def one_bank(spark, d):
    """The questions of two apps: one has a bank, whose file alone is read, the other has none and falls back to its sample."""
    path = _banks(spark, d)
    samples = tables.table(spark, d, "supplier").where("s_suppkey in (0, 7)").select(F.concat(F.lit("app-"), "s_suppkey").alias("slug"), F.array(F.struct(F.col("s_name").alias("id"), F.lit(None).cast("int").alias("answer"))).alias("questions"))
    found = documents.bank_of(spark, path, ["app-0", "app-7"]).select("slug", F.transform("questions", lambda q: F.struct(q["id"].alias("id"), q["answer"].alias("answer"))).alias("questions"))
    return documents.bank_or_sample(samples.select("slug"), found, samples).select("slug", F.explode("questions").alias("q")).select("slug", "q.id", "q.answer")


def _additions(spark, d, complete: bool):
    """A Markdown file for each nation: its customers as terms and scenarios, with an answer key, in which some are missing unless ``complete``."""
    k, name, segment = F.col("c_custkey").cast("string"), F.col("c_name"), F.initcap("c_mktsegment")
    c = tables.table(spark, d, "customer")
    order = F.col("c_custkey").alias("at")
    key = F.when(F.lit(complete) | (F.col("c_custkey") % 7 != 0), F.concat(F.lit("**"), k, F.lit(". "), F.substring(F.lit("ABCD"), (F.col("c_custkey") % 4 + 1).cast("int"), F.lit(1)), F.lit(" — "), segment, F.lit("**\nBecause of\n"), name, F.lit(".\n\n"))).otherwise("")
    own = c.groupBy("c_nationkey").agg(
        F.count("*").cast("string").alias("n"),
        _joined(order, _line("**Term ", k, "**\n", name, "\nof ", segment, ".\n\n")).alias("terms"),
        _joined(order, _line("**", k, ".** Which segment\nhas ", name, "?\nA. ", segment, "\nB. Two\nC. Three ", k, "\nD. Four\n\n")).alias("scenarios"),
        _joined(order, key.alias("line")).alias("answers"),
    )
    head = lambda what: F.concat(F.lit("## Nation "), F.col("c_nationkey").cast("string"), F.lit(" — "), F.col("n"), F.lit(f" {what}\n\n"))
    body = F.concat(F.lit("# Glossary Additions\n\n"), head("new terms"), "terms", F.lit("# Practice Scenario Additions\n\n"), head("scenarios"), "scenarios", F.lit("# Answer Key with Rationales\n\n"), "answers")
    return documents.additions(documents.markdown(spark, _written(own.select(F.col("c_nationkey").alias("file"), body.alias("value")), "additions") + "/file=*"))


CASE = "upper(c_mktsegment[1])||lower(c_mktsegment[2:])"


@query(f"SELECT 'Nation '||c_nationkey AS sub, 'Term '||c_custkey AS term, c_name||' of '||{CASE}||'.' AS def, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey)-1 AS at FROM customer")
def additions_terms(spark, d):
    return _additions(spark, d, True)[0].select("sub", "term", "def", F.col("at").cast("long").alias("at"))


@query("SELECT 'c'||CAST(n AS VARCHAR) AS id, term FROM (SELECT 'Term '||c_custkey AS term, 1000+row_number() OVER (ORDER BY 'Nation '||c_nationkey, c_custkey) AS n FROM customer)")
def numbered_cards(spark, d):
    """New terms of all files get ids after those in use, in the order of sections and of places in them."""
    terms = _additions(spark, d, True)[0].select("sub", "at", "term")
    return bank.numbered(terms, spark.range(1).select(F.lit("c1000").alias("id")), "c", "sub", "at").select(F.col("new_id").alias("id"), "term")


NUMBER = "'q'||lpad(CAST(c_custkey AS VARCHAR), CAST(greatest(3, length(CAST(c_custkey AS VARCHAR))) AS INTEGER), '0')"


@query(f"SELECT {NUMBER} AS id, c_custkey AS n, 'Nation '||c_nationkey AS sub, 'Which segment has '||c_name||'?' AS stem, {CASE}||'|Two|Three '||c_custkey||'|Four' AS choices, c_custkey%4 AS answer, {CASE} AS label, 'Because of '||c_name||'.' AS why FROM customer")
def merged_additions(spark, d):
    _, scenarios, answers = _additions(spark, d, True)
    good, _ = documents.merged_additions(spark.createDataFrame([], "id string, n int"), scenarios, answers)
    return good.select("id", F.col("n").cast("long").alias("n"), "sub", "stem", F.array_join("choices", "|").alias("choices"), F.col("answer").cast("long").alias("answer"), "label", "why")


@query("SELECT 'problem' AS kind, c_custkey AS n, CASE WHEN c_custkey%7=0 THEN 'no answer' ELSE 'number in use' END AS problem FROM customer WHERE c_custkey%7=0 OR c_custkey IN (SELECT s_suppkey FROM supplier)")
def additions_problems(spark, d):
    """While one scenario lacks its answer or takes a number in use, nothing is merged."""
    _, scenarios, answers = _additions(spark, d, False)
    existing = tables.table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_suppkey").cast("int").alias("n"))
    good, problems = documents.merged_additions(existing, scenarios, answers)
    named = lambda rows, kind, problem: rows.select(F.lit(kind).alias("kind"), F.col("n").cast("long").alias("n"), problem.alias("problem"))
    return named(problems, "problem", F.col("problem")).unionByName(named(good, "merged", F.lit("")))


FILE_PARTS = 500


def _trading(spark, d):
    """A Markdown file of the trading kind for every FILE_PARTS parts, with up to 26 signs of sections: parts by size, terms and then scenarios in each."""
    p = tables.table(spark, d, "part")
    k, sign = F.col("p_partkey").cast("string"), F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (F.col("p_size") % 26 + 1).cast("int"), F.lit(1)).alias("sign")
    rows = p.select("p_partkey", F.floor(F.col("p_partkey") / FILE_PARTS).alias("file"), sign, _line("1. **", F.col("p_name"), "** — A ", F.col("p_brand"), ".\n").alias("term"), _line("**", sign, k, ".** What is\n", F.col("p_name"), "? A. ", F.col("p_type"), " B. Brass C. Tin D. None **Answer: ", F.substring(F.lit("ABCD"), (F.col("p_partkey") % 4 + 1).cast("int"), F.lit(1)), ".** It is ", F.col("p_brand"), ".\n\n").alias("ask"))
    own = rows.groupBy("file", "sign").agg(F.count("*").alias("n"), _joined(F.col("p_partkey").alias("at"), F.col("term").alias("line")).alias("terms"), _joined(F.col("p_partkey").alias("at"), F.col("ask").alias("line")).alias("asks"))
    part = own.select("file", "sign", F.concat(F.lit("### "), "sign", F.lit(". Part "), "sign", F.lit(" ("), "n", F.lit(")\n"), "terms", F.lit("\n## "), "sign", F.lit(". Part "), "sign", F.lit("\n\n"), "asks").alias("line"))
    whole = part.groupBy("file").agg(F.concat(F.lit("# Bank\n\n"), _joined(F.col("sign").alias("at"), F.col("line"))).alias("value"))
    return documents.trading(spark, _written(whole, "trading") + "/file=*")


SIGN = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST(p_size%26+1 AS INTEGER), 1)"


@query(f"SELECT {SIGN} AS section, 'Part '||{SIGN} AS section_name, p_name AS term, 'A '||p_brand||'.' AS def FROM part")
def trading_terms(spark, d):
    return _trading(spark, d)[0].select("section", "section_name", "term", "def")


@query(f"SELECT {SIGN}||p_partkey AS key, {SIGN} AS section, 'Part '||{SIGN} AS section_name, 'What is '||p_name||'?' AS stem, p_type||'|Brass|Tin|None' AS options, p_partkey%4 AS answer, 'It is '||p_brand||'.' AS rationale FROM part")
def trading_scenarios(spark, d):
    return _trading(spark, d)[1].select("key", "section", "section_name", "stem", F.array_join("options", "|").alias("options"), F.col("answer").cast("long").alias("answer"), "rationale")


def _notes(spark, d):
    """A text file for each nation."""
    rows = tables.table(spark, d, "nation").select(F.col("n_nationkey").alias("file"), F.repeat("n_name", F.col("n_nationkey") + 1).alias("value"))
    return documents.listing(spark, _written(rows, "notes"))


@query("SELECT n_nationkey AS app, 1 AS files, length(n_name)*(n_nationkey+1)+1 AS bytes FROM nation")
def file_sizes(spark, d):
    sizes = documents.directory_sizes(_notes(spark, d))
    return sizes.select(F.regexp_extract("directory", r"file=(\d+)$", 1).cast("long").alias("app"), "files", "bytes")


@query("SELECT DISTINCT c_nationkey||'-'||c_mktsegment AS name FROM customer WHERE c_mktsegment<>'BUILDING' OR c_nationkey%2=1")
def absent_files(spark, d):
    """Expected files that aren't there: of five segments, only one has files, in every other nation."""
    there = tables.table(spark, d, "nation").where("n_nationkey % 2 = 0").select(F.concat(F.lit("books/"), "n_nationkey", F.lit("-BUILDING")).alias("path"))
    want = tables.table(spark, d, "customer").select(F.concat_ws("-", "c_nationkey", "c_mktsegment").alias("name")).distinct()
    return documents.absent(want, there)


@query("SELECT c_custkey AS id, CASE WHEN c_custkey%3=0 THEN 0 ELSE 1+c_custkey%2 END AS answers, CASE WHEN c_custkey%3<>0 THEN 'i'||c_custkey END AS first FROM customer")
def stored_histories(spark, d):
    """Histories as a device keeps them; unreadable ones are empty."""
    k = F.col("c_custkey")
    item = F.struct(F.concat(F.lit("i"), k).alias("item_id"), F.lit("c").alias("category"), F.lit(True).alias("correct"))
    body = F.when(k % 6 == 0, "{nonsense").when(k % 3 != 0, F.to_json(F.when(k % 2 == 0, F.array(item)).otherwise(F.array(item, item))))
    rows = tables.table(spark, d, "customer").select(k.alias("id"), documents.history(body).alias("h"))
    return rows.select("id", F.size("h").cast("long").alias("answers"), F.get("h.item_id", F.lit(0)).alias("first"))


@query("SELECT s_suppkey AS slug, CASE WHEN s_suppkey%9<>0 THEN s_suppkey*4+s_suppkey%3 ELSE s_suppkey*4 END AS terms, s_suppkey%250 AS questions FROM supplier")
def recounted_catalogue(spark, d):
    """The catalogue rewritten with the content's counts, and read back."""
    k, path = F.col("s_suppkey"), folder(spark, "recounted")
    s = tables.table(spark, d, "supplier")
    rows = documents.recounted(s.select(k.alias("slug"), (k * 4).alias("terms"), (k % 250).alias("questions")), s.where("s_suppkey % 9 <> 0").select(k.alias("slug"), (k * 4 + k % 3).alias("terms"), (k % 250).alias("questions")))
    rows.write.json(path)
    return spark.read.schema("slug long, terms long, questions long").json(path)


@query("SELECT p_type AS section, min(p_partkey) AS at, '## '||p_type||chr(10)||string_agg(p_name||chr(10)||p_brand, chr(10)||chr(10) ORDER BY p_partkey) AS text FROM part GROUP BY 1")
def book_sections(spark, d):
    rows = tables.table(spark, d, "part").select(F.col("p_type").alias("section"), F.col("p_partkey").alias("place"), F.col("p_name").alias("heading"), F.col("p_brand").alias("body"))
    return documents.book_text(rows)
