"""All queries of the library but those of the subpackage llm."""

from quizmill.plans import access, bank, commerce, composites, content, files, learner, planner, streams, updates, viewer  # noqa: F401
from quizmill.plans.registry import QUERIES, SQL  # noqa: F401
