"""All queries of the library but those of optional parts."""

from orrery.plans import arms, audits, episodes, evaluation, fusion, grids, metrics, prep, rerank, retrieval, sequence, statistics, symbolic, text  # noqa: F401
from orrery.plans.registry import ORACLES, QUERIES  # noqa: F401
