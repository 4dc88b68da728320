"""JSON schemas of what a model may answer in each role of a team."""

from __future__ import annotations

# The fields that each role answers with, and who can be assigned a task.
FIELDS = {"lead": ("assignments",), "planner": ("text", "assignments"), "search": ("text",)}
TARGETS = ("search", "planner")


def _closed(properties: dict[str, dict]) -> dict:
    return {"type": "object", "properties": properties, "required": list(properties), "additionalProperties": False}


def response_schema(role: str, model_ids: list[str]) -> dict:
    """The schema for ``role``; one that assigns tasks needs a model to name."""
    if role not in FIELDS:
        raise ValueError(f"role {role!r} is unknown")
    if "assignments" in FIELDS[role] and not model_ids:
        raise ValueError("an assignment needs at least one model")
    text = {"type": "string"}
    task = _closed({"target": text | {"enum": list(TARGETS)}, "id": text, "model_id": text | {"enum": list(model_ids)}, "instruction": text})
    kinds = {"text": text, "assignments": {"type": "array", "items": task}}
    return _closed({f: kinds[f] for f in FIELDS[role]})
