"""Query catalogue: importing this package registers every named query."""

from ledgerlens.plans import (  # noqa: F401
    features_plans,
    fed_plans,
    metric_plans,
    model_plans,
    prep_plans,
    psi_plans,
    report_plans,
    secagg_plans,
    stream_plans,
)
from ledgerlens.plans.registry import ORACLE, QUERIES  # noqa: F401
