"""All registered queries. Importing the modules fills the two dictionaries."""

from . import aggregates, joins, matching, pairing, projections, review, sources, windows  # noqa: F401
from .base import QUERIES, SQL  # noqa: F401
