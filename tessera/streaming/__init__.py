"""Keeping base tables up to date from a stream of cells; an extension, as whole runs are batches."""

from tessera.streaming.refresh import refresh_on_arrival  # noqa: F401
