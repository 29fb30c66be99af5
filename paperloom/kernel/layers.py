"""Which optional content is shown when a document opens (ISO 32000-1, 8.11)."""

from __future__ import annotations

from typing import Any

from .document import Document
from .syntax import Ref

#: Membership policies; each asks its question of the states of the groups.
POLICIES = {"AnyOn": any, "AllOn": all, "AnyOff": lambda states: not all(states), "AllOff": lambda states: not any(states)}
MAX_NESTING = 50


class Layers:
    """States of the groups by the default configuration; no entry, or a damaged one, is shown."""

    def __init__(self, doc: Document):
        self.doc = doc
        all_ = doc.get((doc.catalog or {}).get("OCProperties")) if isinstance(doc.catalog, dict) else None
        usual = doc.get(all_.get("D")) if isinstance(all_, dict) else None
        usual = usual if isinstance(usual, dict) else {}
        self.on, self.off = ({x.num for x in doc.get(usual.get(k)) or [] if isinstance(x, Ref)} for k in ("ON", "OFF"))
        self.base = doc.get(usual.get("BaseState")) != "OFF"

    def state(self, ref: Any) -> bool:
        num = ref.num if isinstance(ref, Ref) else None
        return num not in self.off and (num in self.on or self.base)

    def shown(self, ref: Any) -> bool:
        """Of a group, or of a membership dictionary by its expression or else its policy."""
        d = self.doc.get(ref)
        if not isinstance(d, dict) or d.get("Type") != "OCMD":
            return self.state(ref)
        if isinstance(said := self.doc.get(d.get("VE")), list):
            return self._expression(said, 0)
        members = d.get("OCGs")
        listed = self.doc.get(members)
        states = [self.state(x) for x in (listed if isinstance(listed, list) else [members]) if isinstance(self.doc.get(x), dict)]
        return POLICIES.get(str(self.doc.get(d.get("P"))), any)(states) if states else True

    def _expression(self, x: Any, depth: int) -> bool:
        inner = self.doc.get(x)
        if not isinstance(inner, list) or not inner or depth > MAX_NESTING:
            return self.state(x)
        parts = (self._expression(p, depth + 1) for p in inner[1:])
        return {"And": all, "Or": any, "Not": lambda p: not next(p, False)}.get(str(inner[0]), any)(parts)
