"""Groups of any size in tasks of bounded memory: the engine's blocks, for these operators."""

from __future__ import annotations

from lattica.operators.blocks import BLOCK, deal, groups, join_roots, together

__all__ = ["BLOCK", "deal", "groups", "join_roots", "together"]
