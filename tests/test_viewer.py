"""SQL functions over the viewer's rows: nobody else's rows, nothing without a viewer, the filter at the scan."""

import os

import pytest
from pyspark.errors import AnalysisException

from quizmill.sources import viewer

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


@pytest.fixture
def session(spark):
    viewer.install(spark, DATA)
    yield spark
    viewer.view_as(spark, None)


def test_the_viewer_sees_own_rows_only(session):
    for user in (3, 7):
        viewer.view_as(session, user)
        for name, owner in (("responses", "user_id"), ("study_sessions", "user_id"), ("ebook_purchases", "user_id"), ("profiles", "id")):
            found = {r[0] for r in session.sql(f"SELECT DISTINCT {owner} FROM {name}").collect()}
            assert found <= {user}, name
        assert session.sql("SELECT count(*) FROM responses").first()[0] > 0
        assert session.sql("SELECT sum(total) FROM my_category_stats()").first()[0] == session.sql("SELECT count(*) FROM responses").first()[0]


def test_nobody_sees_nothing(session):
    for call in ("my_category_stats()", "my_daily_trend()", "my_sessions()", "my_weakest_items()", "my_tier()"):
        assert session.sql(f"SELECT * FROM {call}").collect() == []
    assert session.sql("SELECT streak FROM my_streak()").first()[0] == 0 and session.sql("SELECT n FROM my_ebook_count()").first()[0] == 0
    assert session.sql("SELECT * FROM item_difficulty()").count() > 0  # figures of all users, which name nobody


def test_limits_and_defaults(session):
    viewer.view_as(session, 7)
    assert session.sql("SELECT * FROM my_weakest_items(2)").count() == 2
    every = session.sql("SELECT * FROM my_weakest_items(1000)").collect()
    assert session.sql("SELECT * FROM my_weakest_items()").count() == min(30, len(every))
    assert all(r.misses > 0 for r in every)


def test_a_statement_keeps_its_viewer(session):
    viewer.view_as(session, 3)
    own = session.sql("SELECT DISTINCT user_id FROM responses")
    viewer.view_as(session, 7)
    assert [r.user_id for r in own.collect()] == [3]


def test_the_filter_is_pushed_and_no_table_is_left_open(session):
    viewer.view_as(session, 7)
    plan = session.sql("SELECT * FROM my_weakest_items(10)")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(user_id,7)" in plan
    with pytest.raises(AnalysisException):
        session.sql("SELECT * FROM events")


@pytest.mark.parametrize("user", ["7 OR true", "x"])
def test_the_viewer_is_a_number(session, user):
    with pytest.raises(ValueError):
        viewer.view_as(session, user)
