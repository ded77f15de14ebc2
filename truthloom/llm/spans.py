"""What the two span finders share: spans in code points, their text form and digest."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Sequence

Span = tuple[str, int, int]


def in_order(spans: Iterable[Span], kinds: Sequence[str]) -> list[Span]:
    """By start, then by the kind's place in ``kinds``, then by end."""
    rank = {kind: i for i, kind in enumerate(kinds)}
    return sorted(spans, key=lambda s: (s[1], rank[s[0]], s[2]))


def as_text(spans: Iterable[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
