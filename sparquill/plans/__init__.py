from . import aggregates, analyzers, context, derived, details, detectors, filters, graphs, joins, more, mutations, paths, records, scoring, search, source, stores, summaries, windows  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
