"""All registered queries."""

from faultline.plans import incidents, logs, metrics, models, money, streams  # noqa: F401
from faultline.plans.registry import ORACLES, QUERIES  # noqa: F401
