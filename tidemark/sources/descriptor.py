"""Models as JSON documents, there and back."""

from __future__ import annotations

import json
from dataclasses import asdict
from typing import Any

from ..model import Attribute, Entity, Inheritance, Model, Relationship, SortKey, ValueObject


def _members(items: list[dict[str, Any]]) -> tuple[Attribute | ValueObject, ...]:
    return tuple(_value_object(x) if "members" in x else Attribute(**x) for x in items)


def _value_object(x: dict[str, Any]) -> ValueObject:
    return ValueObject(**{**x, "members": _members(x["members"])})


def _relationship(x: dict[str, Any]) -> Relationship:
    keys = tuple(SortKey(**k) for k in x.get("order_by", ()))
    join = tuple(x["join"]) if x.get("join") else None
    return Relationship(**{**x, "order_by": keys, "join": join})


def _parsed(text: str) -> dict[str, Any]:
    try:
        return json.loads(text)
    except json.JSONDecodeError:
        try:
            import yaml
        except ImportError as e:
            raise ValueError("the model is no JSON, and YAML needs PyYAML") from e
        return yaml.safe_load(text)


def load(text: str) -> Model:
    """A validated model from its JSON or, where PyYAML is installed, its YAML."""
    entities = []
    for x in _parsed(text)["entities"]:
        entities.append(
            Entity(
                **{
                    **x,
                    "attributes": tuple(Attribute(**a) for a in x.get("attributes", ())),
                    "relationships": tuple(_relationship(r) for r in x.get("relationships", ())),
                    "value_objects": tuple(_value_object(v) for v in x.get("value_objects", ())),
                    "inheritance": Inheritance(**x["inheritance"]) if x.get("inheritance") else None,
                    "unique": tuple(tuple(u) for u in x.get("unique", ())),
                }
            )
        )
    return Model(*entities)


def dump(model: Model) -> str:
    return json.dumps({"entities": [asdict(e) for e in model]}, indent=1)
