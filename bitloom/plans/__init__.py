"""Planners: elimination orders, cost gates, compiled graphs."""
