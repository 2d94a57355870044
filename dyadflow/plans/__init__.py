"""The registered queries."""

from dyadflow.plans import analysis, coupling, ingest, models, patterns, relations, reports, sequences, statistics  # noqa: F401
