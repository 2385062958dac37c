"""Span lists of detectors: (kind, start, end) in code points, end exclusive."""

from __future__ import annotations

import hashlib

Span = tuple[str, int, int]


def joined(spans: list[Span], kinds: tuple[str, ...]) -> str:
    """kind:start:end by start, then kind in the order of ``kinds``, comma-joined."""
    rank = {k: i for i, k in enumerate(kinds)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], rank[s[0]], s[2])))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
