"""All named queries of the reference's operators, and their SQL twins."""

from __future__ import annotations

from strandwise.plans import external, outcomes, panel  # noqa: F401
from strandwise.plans.base import ORACLES, QUERIES  # noqa: F401
