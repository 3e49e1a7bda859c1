"""Catalogue, bundle, bank and Markdown files as DataFrames; directory listings as relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quizmill.functions import text
from quizmill.sources import places
from quizmill.sources.places import folder

QUESTION = "id string, n int, cat string, stem string, choices array<string>, answer int, label string, why string, sub string"
CARD = "id string, term string, def string, cat string, sub string"
BUNDLE = f"struct<cards:array<struct<{', '.join(c.replace(' ', ':', 1) for c in CARD.split(', '))}>>, questions:array<struct<{', '.join(c.replace(' ', ':', 1) for c in QUESTION.split(', '))}>>, meta:struct<total:int,free:int,split:boolean>>"
BANK = f"slug string, total int, freeIds array<string>, questions array<struct<{', '.join(c.replace(' ', ':', 1) for c in QUESTION.split(', '))}>>, _corrupt_record string"
APP = "struct<slug:string,name:string,family:string,exam:string,audience:string,blurb:string,accent:string,status:string,url:string,terms:int,questions:int,ebook:struct<title:string,format:string,exam:string,price:double,currency:string,hours:double>,hours:struct<study:double,reading:double,blocks:int>,coach:struct<covers:array<string>,keywords:array<string>,forYou:string,notFor:string>>"
REGISTRY = f"planned int, apps array<{APP}>"


def registry(spark: SparkSession, path: str) -> DataFrame:
    """One row per app of a catalogue document."""
    return spark.read.schema(REGISTRY).option("multiLine", True).json(path).select("planned", F.explode("apps").alias("app")).select("planned", "app.*")


def bundle(spark: SparkSession, path: str) -> DataFrame:
    """Content bundles: files of one assignment to window.DATA. file, cards, questions, meta; unreadable files drop out."""
    raw = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    body = F.regexp_extract("value", r"window\.DATA = (\{[\s\S]*\});?\s*$", 1)
    return raw.where(body != "").select("file", F.from_json(body, BUNDLE).alias("d")).where("d is not null").select("file", "d.*")


def banks(spark: SparkSession, path: str) -> DataFrame:
    """Bank documents, in all folders below the path; unreadable ones drop out. A DataFrame sees the files that were there when it was made."""
    rows = spark.read.schema(BANK).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt_record").option("recursiveFileLookup", True).json(path)
    return rows.where("_corrupt_record is null and slug is not null").drop("_corrupt_record")


def bank_of(spark: SparkSession, path: str, slugs: list[str]) -> DataFrame:
    """The bank documents of some apps, of a folder in which each app's lies in a folder of its own (``write_banks``): no other file is opened. An app without a bank has no row."""
    rows = spark.read.schema(f"{BANK}, file string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return rows.where(F.col("file").isin(*slugs)).where("_corrupt_record is null and slug is not null").drop("_corrupt_record", "file")


class BankCache:
    """Bank documents kept for a while: read anew once they are older than ``seconds``, by the time that the caller tells.

    The copy lies in the shared folder, so that neither changed files nor lost executors take it away."""

    def __init__(self, spark: SparkSession, path: str, seconds: float = 300):
        self.spark, self.path, self.seconds, self.rows, self.read_at = spark, path, seconds, None, 0.0

    def get(self, now: float) -> DataFrame:
        if self.rows is None or now - self.read_at >= self.seconds:
            copy = folder(self.spark, "banks-read")
            banks(self.spark, self.path).write.parquet(copy)
            self.rows, self.read_at = self.spark.read.parquet(copy), now
        return self.rows


def bank_or_sample(apps: DataFrame, banks_: DataFrame, samples: DataFrame) -> DataFrame:
    """The bank's questions of each app, the bundle's where the bank is absent or empty. samples: slug, questions."""
    b = banks_.select("slug", F.col("questions").alias("_bank"))
    out = apps.join(b, "slug", "left").join(samples.select("slug", F.col("questions").alias("_sample")), "slug", "left")
    return out.select("slug", F.coalesce(F.when(F.size("_bank") > 0, F.col("_bank")), F.col("_sample")).alias("questions"))


def markdown(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("body"))


def listing(spark: SparkSession, path: str) -> DataFrame:
    """Files of a directory tree: path, length. Contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")


def directory_sizes(files: DataFrame) -> DataFrame:
    return files.groupBy(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("directory")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def absent(expected: DataFrame, files: DataFrame) -> DataFrame:
    """Expected file names that aren't there. expected: name."""
    return expected.join(files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name")), "name", "left_anti")


def history(column: Column) -> Column:
    """A stored history as an array; an unreadable one is empty."""
    return F.coalesce(F.from_json(column, "array<struct<item_id:string,category:string,correct:boolean,created_at:string>>"), F.array())


def additions(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Terms, scenarios and answers of Markdown files with a glossary, a scenario and an answer part. The headings and line forms in the patterns are fixed values of these files."""
    part = lambda a, b: F.regexp_extract("body", rf"(?ms)^# {a}[^\n]*\n(.*?)(?=^# {b}|\z)", 1)
    sub = r"(?ms)^## (.+?) — \d+ (?:new terms|scenarios)[^\n]*\n(.*?)(?=^## |\z)"

    def sections(body):
        zipped = F.arrays_zip(F.regexp_extract_all(body, F.lit(sub), 1).alias("sub"), F.regexp_extract_all(body, F.lit(sub), 2).alias("body"))
        return files.select("file", F.posexplode(zipped).alias("section_at", "s")).select("file", "section_at", "s.sub", F.col("s.body").alias("body"))

    term = r"(?ms)^\*\*([^*\n]+?)\*\*\s*\n(.*?)(?=\n\s*\n|^\*\*|\z)"
    terms = sections(part("Glossary Additions", "Practice")).select("file", "sub", "section_at", F.posexplode(F.arrays_zip(F.regexp_extract_all("body", F.lit(term), 1).alias("term"), F.regexp_extract_all("body", F.lit(term), 2).alias("def"))).alias("at", "t"))
    terms = terms.select("file", "sub", "section_at", "at", F.trim("t.term").alias("term"), F.trim(text.fold_lines(F.col("t.def"))).alias("def"))
    item = r"(?ms)^\*\*(\d+)\.\*\*\s*(.*?)\s*^A\. (.*?)\s*^B\. (.*?)\s*^C\. (.*?)\s*^D\. ([^\n]*)"
    groups = [F.regexp_extract_all("body", F.lit(item), k) for k in range(1, 7)]
    scenarios = sections(part("Practice Scenario Additions", "Answer Key")).select("file", "sub", F.explode(F.arrays_zip(*(g.alias(n) for g, n in zip(groups, ("n", "stem", "a", "b", "c", "d"), strict=True)))).alias("q"))
    scenarios = scenarios.select("file", "sub", F.col("q.n").cast("int").alias("n"), text.fold_lines(F.col("q.stem")).alias("stem"), F.array(*(F.trim(f"q.{c}") for c in "abcd")).alias("choices"))
    key = r"(?ms)^\*\*(\d+)\. ([A-D]) — ([^*\n]+?)\*\*\s*\n?(.*?)(?=\n\s*\n|^\*\*|\z)"
    found = [F.regexp_extract_all(part("Answer Key with Rationales", "Nothing follows"), F.lit(key), k) for k in range(1, 5)]
    answers = files.select("file", F.explode(F.arrays_zip(*(g.alias(n) for g, n in zip(found, ("n", "letter", "label", "why"), strict=True)))).alias("k"))
    answers = answers.select("file", F.col("k.n").cast("int").alias("n"), (F.ascii("k.letter") - 65).alias("answer"), F.trim("k.label").alias("label"), F.trim(text.fold_lines(F.col("k.why"))).alias("why"))
    return terms, scenarios, answers


def merged_additions(existing: DataFrame, scenarios: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(questions, problems): scenarios with their answers, numbered as in the file; nothing is merged while there are problems.

    existing: id, n. A scenario needs an answer, four choices and a number not in use."""
    rows = scenarios.join(answers, ["file", "n"], "left").join(existing.select(F.col("n").alias("_used")).distinct(), F.col("n") == F.col("_used"), "left")
    nth = F.row_number().over(Window.partitionBy("n").orderBy("file"))
    problem = F.when(F.col("answer").isNull(), "no answer").when(F.size(F.filter("choices", lambda c: c != "")) < 4, "choices").when(F.col("_used").isNotNull() | (nth > 1), "number in use")
    rows = rows.withColumn("problem", problem)
    problems = rows.where("problem is not null").select("file", "n", "problem")
    good = rows.where("problem is null").join(F.broadcast(problems.limit(1).select(F.lit(1).alias("_any"))), F.lit(True), "left_anti")  # one row at most
    return good.select(text.numbered("q", F.col("n")).alias("id"), "n", "sub", "stem", "choices", "answer", "label", "why"), problems


# A section's heading, a term's line, the first line of a scenario, and its answer: fixed values
HEADING, TERM = r"^#{2,3} ([A-Z])\. (.+?)(?: \(\d+\))?\s*$", r"^\d+\. \*\*(.+?)\*\*\s*—\s*(.+)$"
SCENARIO, ANSWER = r"^\*\*([A-Z]\d+)\.\*\*", r"(?s)\*\*Answer: ([A-D])\.?\*\*\s*(.*)$"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Every line of text files, with its file, the split of the file that it is read in, and its place there. A large file is many splits, a task each."""
    rows = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"))
    return places.stored(rows, "lines")  # so that a line keeps its place when a task is repeated


def carried(rows: DataFrame, **values: Column) -> DataFrame:
    """For each name the last value that isn't null up to each line of a file, by a segmented scan: the last of every split is passed on to
    the later splits of its file, which are few rows, and each split is scanned on its own. rows: file, split, at and the lines' columns."""
    marked = rows.withColumns({f"_{n}": v for n, v in values.items()})
    order = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    ends = marked.groupBy("file", "split").agg(*(F.max_by(f"_{n}", F.when(F.col(f"_{n}").isNotNull(), F.col("at"))).alias(f"_{n}") for n in values))
    carry = ends.select("file", "split", *(F.last(f"_{n}", True).over(order).alias(f"_carried_{n}") for n in values))
    own = Window.partitionBy("file", "split").orderBy("at")
    out = marked.join(carry, ["file", "split"])
    return out.select(*rows.columns, *(F.coalesce(F.last(f"_{n}", True).over(own), F.col(f"_carried_{n}")).alias(n) for n in values))


def trading(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(terms, scenarios) of Markdown files in which section headings hold for the lines that follow, wherever a file is split."""
    heading = lambda k: F.nullif(F.regexp_extract("line", HEADING, k), F.lit(""))
    start = F.nullif(F.regexp_extract("line", SCENARIO, 1), F.lit(""))
    # a block reaches to the next one, or to a heading; equal keys in one section are blocks of their own by where they begin
    begins = F.when(heading(1).isNotNull(), F.struct(F.lit(None).cast("string").alias("key"), "split", "at")).when(start.isNotNull(), F.struct(start.alias("key"), "split", "at"))
    found = carried(lines(spark, path), section=heading(1), section_name=heading(2), block=begins)
    terms = found.where(F.col("line").rlike(TERM)).select("file", "split", "at", "section", "section_name", F.regexp_extract("line", TERM, 1).alias("term"), F.trim(F.regexp_extract("line", TERM, 2)).alias("def"))
    told = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("split", "at", "line"))), lambda x: x["line"]), "\n")
    block = found.where("block.key is not null").groupBy("file", "block").agg(F.first("section").alias("section"), F.first("section_name").alias("section_name"), told.alias("body"))
    option = lambda a, b: F.trim(F.regexp_extract("body", rf"(?s)\b{a}[.)]\s*(.*?)\s*(?={b})", 1))
    scenarios = block.select("file", F.col("block.split").alias("split"), F.col("block.at").alias("at"), F.col("block.key").alias("key"), "section", "section_name", F.trim(text.fold_lines(F.regexp_extract("body", r"(?s)^\*\*[A-Z]\d+\.\*\*\s*(.*?)\s*(?=\bA[.)]\s)", 1))).alias("stem"), F.array(option("A", r"\bB[.)]\s"), option("B", r"\bC[.)]\s"), option("C", r"\bD[.)]\s"), option("D", r"\*\*Answer")).alias("options"), (F.ascii(F.regexp_extract("body", ANSWER, 1)) - 65).alias("answer"), F.trim(text.fold_lines(F.get(F.split(F.regexp_extract("body", ANSWER, 2), r"\n(?:---|\s*\n)"), F.lit(0)))).alias("rationale"))
    return terms, scenarios.where("answer between 0 and 3")


def write_banks(questions: DataFrame, path: str) -> None:
    """One JSON document for each slug, in a folder of its own. questions: slug and a question's columns."""
    columns = [c for c in questions.columns if c != "slug"]
    whole = questions.groupBy("slug").agg(F.count("*").alias("total"), F.array_sort(F.collect_list(F.struct(*columns))).alias("questions"))
    whole.withColumn("file", F.col("slug")).write.mode("overwrite").partitionBy("file").json(path)


def write_bundle(cards: DataFrame, questions: DataFrame, path: str) -> None:
    """The assignment of one bundle to window.DATA as a text file. A bundle is a page of data."""
    c = cards.agg(F.array_sort(F.collect_list(F.struct(*cards.columns))).alias("cards"))
    q = questions.agg(F.array_sort(F.collect_list(F.struct(*questions.columns))).alias("questions"))
    whole = F.to_json(F.struct("cards", "questions", F.struct(F.size("questions").alias("total"), F.size("questions").alias("free"), F.lit(True).alias("split")).alias("meta")))
    c.crossJoin(q).select(F.concat(F.lit("window.DATA = "), whole, F.lit(";"))).write.mode("overwrite").text(path)  # one row each


def recounted(apps: DataFrame, counts: DataFrame) -> DataFrame:
    """Catalogue rows with counts from the content. counts: slug, terms, questions."""
    c = counts.select("slug", F.col("terms").alias("_t"), F.col("questions").alias("_q"))
    return apps.join(c, "slug", "left").withColumn("terms", F.coalesce("_t", "terms")).withColumn("questions", F.coalesce("_q", "questions")).drop("_t", "_q")


def book_text(rows: DataFrame) -> DataFrame:
    """The text of a book's sections in order of first appearance. rows: section, place, heading, body."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("place", "heading", "body"))), lambda x: F.concat_ws("\n", x["heading"], x["body"]))
    return rows.groupBy("section").agg(F.min("place").alias("at"), F.concat(F.lit("## "), F.first("section"), F.lit("\n"), F.array_join(parts, "\n\n")).alias("text"))
