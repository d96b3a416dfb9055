"""Change flows: a batch of requests and the state of some tables in, new state and rejects out.

Every flow sees the state as it was before the batch. Within a batch, requests for the same row
are settled by ``request_id`` (first or last one, as each flow says) with aggregations that combine
on the map side, so a key that most of the batch names is no bottleneck.
"""

from merchlake.plans.changes.outcome import Outcome

__all__ = ["Outcome"]
