"""JSON schemas as request payloads need them."""

from __future__ import annotations

from typing import Any

#: Keys that a request schema does not carry.
DROPPED = frozenset({"$defs", "additionalProperties", "title"})


def inlined(schema: dict[str, Any]) -> dict[str, Any]:
    """The schema with every local reference replaced by what it names, and without DROPPED keys.
    A property may have any name, also a dropped one. References must not form a cycle."""
    names = {f"#/$defs/{k}": v for k, v in schema.get("$defs", {}).items()}

    def resolve(node: Any, open_refs: tuple[str, ...] = ()) -> Any:
        if isinstance(node, list):
            return [resolve(x, open_refs) for x in node]
        if not isinstance(node, dict):
            return node
        if (ref := node.get("$ref")) is not None:
            if ref in open_refs:
                raise ValueError(f"{ref} refers to itself")
            return resolve(names[ref], (*open_refs, ref))
        out = {}
        for key, value in node.items():
            if key == "properties":
                out[key] = {name: resolve(x, open_refs) for name, x in value.items()}
            elif key not in DROPPED:
                out[key] = resolve(value, open_refs)
        return out

    return resolve(schema)
