"""All registered queries; importing the package registers them."""

from . import answering, evaluating, queries, shaping, streams  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
