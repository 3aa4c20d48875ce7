"""Feature tables and the run log."""
