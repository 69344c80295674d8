"""Where points come from and where results go."""

from .files import points_csv, points_json, points_memory, read_model, write_model, write_svg

__all__ = ["points_csv", "points_json", "points_memory", "read_model", "write_model", "write_svg"]
