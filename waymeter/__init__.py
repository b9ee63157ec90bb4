"""Routed-request analytics on Spark.

Requests are assigned to candidate models by policies written as Spark columns or
stateful streaming operators; what happened is folded from event logs into one row
per request, graded, priced, and audited across restarts.
"""

from waymeter.session import build_session

__all__ = ["build_session"]
