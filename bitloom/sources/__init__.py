"""Generated relations and file sources."""
