"""Which plan answers a query."""
