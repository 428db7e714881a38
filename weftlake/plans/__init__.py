"""Registered queries, by topic; importing the package registers them all."""

from . import computed, crawls, queries, readers, records, states  # noqa: F401
