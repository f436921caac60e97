"""Feature pipelines and the registered queries."""
