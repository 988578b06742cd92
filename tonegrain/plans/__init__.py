"""Composed jobs, the query catalogue and its SQL counterparts."""
