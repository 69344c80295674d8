"""Fits over streams: moments add up, so a windowed fit is a windowed aggregate."""

from .windows import solved, stream_to_rows, windowed_moments

__all__ = ["solved", "stream_to_rows", "windowed_moments"]
