"""Operators on recordings that arrive as a stream."""
