"""Content deduplication on Spark."""

from .functions.extensions import clean_extensions
from .functions.rules import PATH_RULES
from .plans.engine import Outcome, run_dedupe

__all__ = ["PATH_RULES", "Outcome", "clean_extensions", "run_dedupe"]
