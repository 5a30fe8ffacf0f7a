"""All queries over the supplied tables, and the SQL that checks them."""

from quaver.plans import anchors, compare, content, evaluation, files, flows, history, melody, ordered, rules  # noqa: F401  they register themselves
from quaver.plans.base import ORACLES, QUERIES  # noqa: F401
