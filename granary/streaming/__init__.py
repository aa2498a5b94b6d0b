"""Incremental loading. The dialect itself has no streams."""
