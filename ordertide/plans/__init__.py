"""Named queries over the star-schema tables, each with its SQL twin where SQL can say it."""

from ordertide.plans import sources, cleaning, relations, process, history, peers, detectors, streaming, cohort, evidence  # noqa: F401
from ordertide.plans.registry import ORACLES, QUERIES  # noqa: F401
