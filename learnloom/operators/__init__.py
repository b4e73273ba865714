"""Operators on pages, points, relations, graphs, recommendations, emotions and messages."""
