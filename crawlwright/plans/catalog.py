"""Importing this module registers every query."""

from crawlwright.plans import duck_views, q_audit, q_extract, q_graph, q_images, q_sources, q_spelling, q_stream, q_urls, q_work  # noqa: F401
