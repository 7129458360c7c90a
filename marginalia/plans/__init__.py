"""The named queries; importing the modules registers them."""

from marginalia.plans import alignment, encoding, frontends, functions, hmm, models, numeric, retrieval, selection, subword, text  # noqa: F401
from marginalia.plans.registry import ORACLES, QUERIES  # noqa: F401
