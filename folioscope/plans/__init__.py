"""Queries over the driver's tables, by family; importing the package registers them."""

from . import analytics, answers, concepts, corpus, grounding, layout, metadata, questions, retrieval, service, sheets, store, streams, tagging, understanding  # noqa: F401
