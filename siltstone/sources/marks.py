"""Comments that hush findings."""

from __future__ import annotations

import re

from ..plans.catalog import RULES

MARK = "siltstone:ignore"


def ignored_rules(comment: str) -> list[str] | None:
    """The rules named between the mark and a dash or bracket; None, for all of them, where none is a rule's name."""
    scope = re.split(r"\(|--|—", comment.split(MARK, 1)[-1], maxsplit=1)[0]
    return sorted({w for w in re.findall("[a-z][a-z-]*[a-z]", scope) if w in RULES}) or None
