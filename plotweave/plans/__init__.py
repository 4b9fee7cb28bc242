"""Plan-level building blocks: how rows are spread, bucketed and joined."""
