"""Case tables, properties and files: rules that SQL on the driver's tables doesn't reach."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quizmill.functions import numbers, text
from quizmill.operators import access, bank, checks, commerce, drill, learner, planner, recommend, search
from quizmill.sources import documents
from quizmill.streaming import events


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


COVER = [
    (None, None, None, "a", False), ("free", None, True, "a", False), ("all_access", None, True, "a", True), ("all_access", None, False, "a", False),
    ("pro", "a", True, "a", True), ("pro", "b", True, "a", False), ("pro", None, True, "a", False), ("pro", "a", False, "a", False), ("pro", "a", None, "a", True),
]


def test_covers(spark):
    rows = spark.createDataFrame(COVER, "tier string, scope string, active boolean, slug string, want boolean")
    got = rows.select(access.covers(F.col("tier"), F.col("scope"), F.col("active"), F.col("slug")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)


def test_rounding(spark):
    assert [one(spark, numbers.half_up(F.lit(x))) for x in (-2.5, 2.5, 0.49, 1.5)] == [-2, 3, 0, 2]
    assert one(spark, numbers.percent(F.lit(0), F.lit(0))) == 0
    assert one(spark, numbers.clock(F.lit(65))) == "1:05" and one(spark, numbers.money(F.lit(1599))) == "$15.99"


@pytest.mark.parametrize(("days", "pace", "verdict", "short", "cuts"), [(21, 7.0, "tight", 7.5, 4), (21, 4.0, "short", 16.5, 4), (90, 8.0, "comfortable", 0.0, 0), (28, 7.5, "workable", 0.0, 0), (35, 5.0, "tight", 3.5, 4), (0, 10.0, "past", 28.5, 0), (None, 8.0, "unknown", None, 0), (30, 0.0, "unknown", None, 0)])
def test_timeline(spark, days, pace, verdict, short, cuts):
    r = planner.timeline(spark.createDataFrame([(28.5, days, pace)], "hours double, days int, hours_per_week double")).first()
    assert (r.verdict, r.shortfall, r.cuts) == (verdict, short, cuts)


def test_days(spark):
    assert one(spark, planner.days_until(F.lit("2026-03-15"), "2026-03-01")) == 14
    assert one(spark, planner.days_until(F.lit("2026-01-01"), "2026-03-01")) == 0
    assert one(spark, planner.days_until(F.lit("soon"), "2026-03-01")) is None
    assert one(spark, planner.planner_days_left(F.lit("2026-03-02 13:00:00"), "2026-03-01 12:00:00")) == 2
    assert one(spark, planner.months_of_study(F.lit(28.5), F.lit(8.0))) == 1
    assert one(spark, planner.months_of_study(F.lit(28.5), F.lit(0.0))) is None


def test_plan_advice(spark):
    rows = spark.createDataFrame([(1, False), (2, False), (2, True), (3, True)], "exams long, simultaneous boolean")
    got = [(r.pick, r.alternative, r.saved_cents) for r in planner.plan_advice(rows).collect()]
    assert got == [("pro", None, -700), ("pro", "all_access", 99), ("all_access", None, 99), ("all_access", None, 898)]


def test_streak_is_the_plain_loop(spark):
    import datetime

    r, today = random.Random(4), datetime.date(2024, 1, 30)
    rows = [(u, datetime.datetime.combine(today - datetime.timedelta(days=d), datetime.time(9))) for u in range(60) for d in range(12) if r.random() < 0.75]
    got = {x.user_id: x.streak for x in learner.streak(spark.createDataFrame(rows, "user_id long, created_at timestamp_ntz"), "2024-01-30 23:59:59").collect()}
    for u in {x for x, _ in rows}:
        days, n = {t.date() for x, t in rows if x == u}, 0
        d = today if today in days else today - datetime.timedelta(days=1)
        while d in days:
            n, d = n + 1, d - datetime.timedelta(days=1)
        assert got[u] == n


def test_cap_is_the_greedy_loop(spark):
    r = random.Random(5)
    rows = [(u, f"i{k}", f"c{r.randint(0, 3)}", float(r.randint(0, 20))) for u in range(20) for k in range(r.randint(1, 30))]
    got = recommend.capped(spark.createDataFrame(rows, "user_id long, item_id string, cat string, score double"), 10).collect()
    for u in range(20):
        want, n = [], Counter()
        for x in sorted((x for x in rows if x[0] == u), key=lambda x: (-x[3], x[1])):
            if len(want) < 10 and n[x[2]] < math.ceil(4):
                n[x[2]] += 1
                want.append(x[1])
        assert [g.item_id for g in sorted((g for g in got if g.user_id == u), key=lambda g: g.rank)] == want
    padded = recommend.padded(spark.createDataFrame(rows, "user_id long, item_id string, cat string, score double"), 10).groupBy("user_id").count().collect()
    assert all(p["count"] == min(10, sum(x[0] == p.user_id for x in rows)) for p in padded)


def test_grants_do_not_change_on_replay(spark):
    rows = [(1, "b", None, 1, 5, 1), (1, "b", "s1", 1, 7, 2), (1, "b", "s2", 1, 8, 3), (2, "b", "s1", 1, 9, 1)]
    df = spark.createDataFrame(rows, "customer long, slug string, session string, line int, amount int, created_at int")
    first = commerce.granted(df).drop("events").collect()
    assert sorted(first) == sorted(commerce.granted(df.union(df)).drop("events").collect())
    assert {(r.customer, r.session) for r in first} == {(1, "s1"), (2, "s1")}


def test_boxes(spark):
    r = random.Random(6)
    rows = [(u, "i", r.randint(0, 2), float(k), k) for u in range(30) for k in range(r.randint(1, 15))]
    got = {x.user_id: x.box for x in drill.boxes(spark.createDataFrame(rows, "user_id long, item_id string, score int, ts double, id long"), "user_id", "item_id").collect()}
    for u in range(30):
        box = 0
        for x in rows:
            if x[0] == u:
                box = min(box + 1, 3) if x[2] == 2 else box if x[2] == 1 else 0
        assert got[u] == box


def test_search(spark):
    apps = spark.createDataFrame([("law", "Law", "Bar", "lawyers", "live", ["bar exam"], ["contracts", "civil law"]), ("nurse", "Nurse", "NCLEX", "nurses", "live", ["nclex"], ["nursing", "patient care"]), ("old", "Old", "NCLEX", "x", "planned", ["nclex"], [])], "slug string, name string, exam string, audience string, status string, covers array<string>, keywords array<string>")
    queries = spark.createDataFrame([(1, "the NCLEX test"), (2, "nursing"), (3, "civil law for me"), (4, "qqqq"), (5, "the exam"), (6, None)], "query_id int, query string")
    got = {(r.query_id, r.slug): r.score for r in search.search(queries, apps).collect()}
    assert set(got) == {(1, "nurse"), (2, "nurse"), (3, "law")}
    assert got[1, "nurse"] == 60 + 6 and got[3, "law"] == 30
    table = spark.createDataFrame([(1, "which", ["law", "nurse"], ["law", "nurse"])], "place int, decision string, among array<string>, options array<string>")
    both = spark.createDataFrame([(9, "law", 1), (9, "nurse", 2)], "query_id int, slug string, rank int")
    assert search.decisions(both, table).first().options == ["law", "nurse"]


def test_checks(spark):
    rows = [
        ("s", "q1", ["alpha river", "stone garden", "c c", "d d"], 0, "stone garden wins here because (B) fits. More."),
        ("s", "q2", ["alpha river", "stone garden", "c c", "d d"], 1, "stone garden wins here. alpha river (B) is not it"),
        ("s", "q3", ["alpha river", "no stone garden", "c c", "d d"], 0, "stone garden wins"),
        ("s", "q4", None, 0, "x"), ("s", "q5", ["a"], None, "x"), ("s", "q6", ["a"], 0, None),
    ]
    df = spark.createDataFrame(rows, "slug string, id string, choices array<string>, answer int, why string")
    assert [(r.id, r.says, r.dismissed) for r in checks.miskeys(df).collect()] == [("q1", 1, False)]
    assert [(r.id, r.letter, r.belongs) for r in checks.stale_letters(df).collect()] == [("q2", "B", "A")]
    assert tuple(checks.totals(df, spark.createDataFrame([("s", "q1")], "slug string, id string")).first()) == (3, 0, 1, 1)


def test_text(spark):
    assert one(spark, text.norm(F.lit("  A+B,  c\n"))) == "a+b c"
    assert one(spark, text.tokens(F.lit("I want the CISSP exam"))) == ["cissp"]
    assert one(spark, text.lead_clause(F.lit("First. Second (A) third"))) == "First."
    assert one(spark, text.negated(F.lit("None of it"))) and not one(spark, text.negated(F.lit("Nobody")))
    assert one(spark, text.letter_index(F.lit("C"))) == 2 and one(spark, text.letter_index(F.lit("X"))) == -1
    assert one(spark, text.watermark(F.lit("Ann"), F.lit("0123456789"), F.lit("2026-01-01"), "B")) == "Licensed to Ann · 01234567 · 2026-01-01 · B"
    assert one(spark, text.flattened("m", {"a": F.lit(1), "b": F.lit(None).cast("int")})) == {"m[a]": "1"}


def test_files(spark, tmp_path):
    (tmp_path / "registry.json").write_text('{"planned": 3,\n "apps": [{"slug": "a", "terms": 2, "coach": {"covers": ["x"]}}, {"slug": "b"}]}')
    (tmp_path / "content.js").write_text('window.DATA = {"cards":[{"id":"c000","term":"T"}],"questions":[{"id":"q001","choices":["1","2"],"answer":1}],"meta":{"total":9,"free":1,"split":true}};\n')
    (tmp_path / "bad.js").write_text("window.OTHER = 1;")
    assert [r.slug for r in documents.registry(spark, str(tmp_path / "registry.json")).orderBy("slug").collect()] == ["a", "b"]
    b = documents.bundle(spark, str(tmp_path / "*.js")).collect()
    assert len(b) == 1 and b[0].meta.total == 9 and b[0].questions[0].answer == 1
    (tmp_path / "bank.json").write_text('{"slug":"a","total":1,"freeIds":["q001"],"questions":[{"id":"q001","answer":2}]}')
    (tmp_path / "broken.json").write_text("{nonsense")
    banks = documents.banks(spark, [str(tmp_path / "bank.json"), str(tmp_path / "broken.json")])
    assert [r.slug for r in banks.collect()] == ["a"]
    files = documents.listing(spark, str(tmp_path))
    want = spark.createDataFrame([("bank.json",), ("none.pdf",)], "name string")
    assert [r.name for r in documents.absent(want, files).collect()] == ["none.pdf"]
    assert documents.directory_sizes(files).first().files == 5
    samples = spark.createDataFrame([("a", ["x"]), ("b", ["y"])], "slug string, questions array<string>")
    both = documents.bank_or_sample(samples.select("slug"), spark.createDataFrame([("a", [])], "slug string, questions array<string>"), samples)
    assert sorted(map(tuple, both.collect())) == [("a", ["x"]), ("b", ["y"])]


ADDITIONS = """# Glossary Additions

## Rivers — 2 new terms

**Delta**
Where a river
meets the sea.

**Ford**
A crossing.

# Practice Scenario Additions

## Rivers — 2 scenarios

**1.** Which way
now?
A. Left
B. Right
C. Up
D. Down

**2.** And then?
A. One
B. Two
C. Three
D. Four

# Answer Key with Rationales

**1. B — turn**
Right is right.

**2. D — count**
Four it is.
"""

TRADING = """# Bank

### A. Orders (2)
1. **Limit** — A price bound.
2. **Market** — At once.

## A. Orders (1)
**A1.** What fills first? A. Limit B. Market C. Stop D. None **Answer: B.** It takes
what is there.
"""


def test_markdown(spark, tmp_path):
    (tmp_path / "add.md").write_text(ADDITIONS)
    files = documents.markdown(spark, str(tmp_path / "add.md"))
    terms, scenarios, answers = documents.additions(files)
    assert [(r.sub, r.term, getattr(r, "def")) for r in terms.orderBy("at").collect()] == [("Rivers", "Delta", "Where a river meets the sea."), ("Rivers", "Ford", "A crossing.")]
    assert [(r.n, r.stem, r.choices) for r in scenarios.orderBy("n").collect()] == [(1, "Which way now?", ["Left", "Right", "Up", "Down"]), (2, "And then?", ["One", "Two", "Three", "Four"])]
    assert [(r.n, r.answer, r.label, r.why) for r in answers.orderBy("n").collect()] == [(1, 1, "turn", "Right is right."), (2, 3, "count", "Four it is.")]
    good, problems = documents.merged_additions(spark.createDataFrame([("q009", 9)], "id string, n int"), scenarios, answers)
    assert sorted(r.id for r in good.collect()) == ["q001", "q002"] and problems.count() == 0
    good, problems = documents.merged_additions(spark.createDataFrame([("q002", 2)], "id string, n int"), scenarios, answers)
    assert good.count() == 0 and [r.problem for r in problems.collect()] == ["number in use"]
    (tmp_path / "trade.md").write_text(TRADING)
    terms, scenarios = documents.trading(spark, str(tmp_path / "trade.md"))
    assert [(r.section, r.section_name, r.term) for r in terms.orderBy("at").collect()] == [("A", "Orders", "Limit"), ("A", "Orders", "Market")]
    s = scenarios.collect()
    (tmp_path / "more.md").write_text(TRADING.replace("what is there.\n", "what is there.\n\nA note.\n---\n\n## B. Risk (0)\nMore.\n"))
    assert documents.trading(spark, str(tmp_path / "more.md"))[1].drop("file").collect() == scenarios.drop("file").collect()
    assert [(r.key, r.stem, r.options, r.answer, r.rationale) for r in s] == [("A1", "What fills first?", ["Limit", "Market", "Stop", "None"], 1, "It takes what is there.")]


def test_writers(spark, tmp_path):
    q = spark.createDataFrame([("a", "q001", 1), ("a", "q002", 2)], "slug string, id string, answer int")
    documents.write_banks(q, str(tmp_path / "banks"))
    assert documents.banks(spark, str(tmp_path / "banks")).first().total == 2
    documents.write_bundle(spark.createDataFrame([("c000", "T")], "id string, term string"), q.drop("slug"), str(tmp_path / "bundle"))
    assert documents.bundle(spark, str(tmp_path / "bundle")).first().meta.total == 2
    text_ = documents.book_text(spark.createDataFrame([("S", 1, "h", "b"), ("S", 2, "i", "c")], "section string, place int, heading string, body string")).first().text
    assert text_ == "## S\nh\nb\n\ni\nc"
    apps = documents.recounted(spark.createDataFrame([("a", 1, 1)], "slug string, terms int, questions int"), spark.createDataFrame([("a", 5, 6)], "slug string, terms int, questions int"))
    assert tuple(apps.first()) == ("a", 5, 6)


def test_bank_edges(spark):
    b = spark.createDataFrame([("q1", 0, ["a"], "w"), ("q2", None, ["a"], "w"), ("q3", 0, None, "w"), ("q4", 0, ["a"], None)], "id string, answer int, choices array<string>, why string")
    assert [r.id for r in bank.gradable(b).collect()] == ["q1"]
    assert bank.public_form(b).columns == ["id", "choices"]


def test_events_edges(spark):
    body = spark.createDataFrame([('{"event":"signup","email":"a"}',), ('{"event":"signup"}',), ("x" * 70_000,), ("nonsense",)], "body string")
    assert [tuple(r) for r in events.mails(body).collect()] == [("a", "signup", "Welcome")]


def test_bank_cache(spark, tmp_path):
    write = lambda slug: documents.write_banks(spark.createDataFrame([(slug, "q001", 1)], "slug string, id string, answer int"), str(tmp_path / "banks"))
    write("a")
    cache = documents.BankCache(spark, str(tmp_path / "banks"), 300)
    slugs = lambda now: sorted(r.slug for r in cache.get(now).collect())
    assert slugs(0) == ["a"]
    write("b")
    assert slugs(299) == ["a"]
    assert slugs(300) == ["b"]


def test_summary_model(spark):
    from quizmill.operators import planner

    for terms, questions in ((120, 100), (0, 0), (207, 217), (-1, 3)):
        e = planner.estimated(spark.createDataFrame([(terms, questions)], "terms long, questions long")).first()
        assert planner.hours_of(terms, questions) == (e.hours, e.blocks, {a: e[f"{a}_hours"] for a in planner.ACTIVITIES})


@pytest.mark.parametrize("secret", ["whsec_x", "k" * 64, "long" * 30, "schlüssel"])
def test_signatures(spark, secret):
    import hashlib
    import hmac

    body, at = '{"type": "x", "é": 1}', 1_700_000_000
    sign = hmac.new(secret.encode(), f"{at}.{body}".encode(), hashlib.sha256).hexdigest()
    assert one(spark, events.signed(F.lit(body), F.lit(at), secret)) == sign
    rows = [(body, f"t={at},v1={sign}", at + 300), (body, f"t={at},v1={sign}", at + 301), (body + " ", f"t={at},v1={sign}", at), (body, f"t={at},v0={sign}", at), (body, f"v1={sign}", at), (body, f"t={at},v1=00,v1={sign}", at), (body, None, at), (None, f"t={at},v1={sign}", at)]
    good = events.verified(spark.createDataFrame(rows, "body string, signature string, received long"), secret)
    assert sorted((r.signature, r.received) for r in good.collect()) == sorted([(rows[0][1], at + 300), (rows[5][1], at)])


def test_progress_does_not_hang_on_the_order_of_sums(spark):
    """Ten times 0.3 minutes are three, half of a tenth of an hour, though doubles add up to less."""
    blocks = spark.createDataFrame([(1, 0.3)] * 10, "user_id long, minutes double").coalesce(1)
    row = planner.progress(blocks, 28.5, 29, 21).first()
    assert (row.minutes, row.tenths_of_hours) == (3.0, 1)
