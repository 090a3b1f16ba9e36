"""Query keys over the test tables. Importing this package registers every key."""

from riskflow.plans import (  # noqa: F401
    decision_queries, encoding_queries, eval_queries, feature_queries, io_queries, metric_queries, profile_queries,
    row_queries, stream_queries, train_queries)
from riskflow.plans.registry import ORACLES, QUERIES  # noqa: F401
