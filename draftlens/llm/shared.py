"""Pieces several operators share, as the library's graph operators have them."""

from draftlens.operators.graph import connected_components, cut, drop, scratch_dir

__all__ = ["connected_components", "cut", "drop", "scratch_dir"]
