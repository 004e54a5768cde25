"""Every operator as a query over the given tables, with the SQL that has to give the same rows."""

from tillmark.registered.base import oracles, runners

__all__ = ["oracles", "runners"]
