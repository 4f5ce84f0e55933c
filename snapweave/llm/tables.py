"""Intermediate tables in the session's shared checkpoint folder."""

from __future__ import annotations

from snapweave.session import written

__all__ = ["written"]
