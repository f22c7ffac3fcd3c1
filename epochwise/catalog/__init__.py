"""Named queries over the driver tables, each with its SQL twin where SQL can say it.

A module of this package holds ``QUERIES: dict[str, tuple[callable, str | None]]``.
"""
