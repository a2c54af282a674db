"""Bundles (type name to base layer and overlays) and the in-memory layer repository."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from .compiler import compile_schema
from .compose import compose
from .layer import Layer, SchemaError
from .reader import layer_from_json


@dataclass
class Repository:
    """Layers by id."""

    layers: dict[str, Layer] = field(default_factory=dict)

    def put(self, layer: Layer) -> Layer:
        self.layers[layer.id] = layer
        return layer

    def get(self, id_: str) -> Layer | None:
        return self.layers.get(id_)

    def remove(self, id_: str) -> None:
        self.layers.pop(id_, None)

    def by_type(self, value_type: str, kind: str = "Schema") -> list[Layer]:
        return [x for x in self.layers.values() if x.value_type == value_type and x.kind == kind]


@dataclass
class Variant:
    schema: str
    overlays: list[str] = field(default_factory=list)


@dataclass
class Bundle:
    """Variants over a repository. A base bundle's variants are inherited; a name given twice is an error."""

    variants: dict[str, Variant] = field(default_factory=dict)
    repository: Repository = field(default_factory=Repository)
    base: Bundle | None = None
    _built: dict[str, Layer] = field(default_factory=dict)

    @staticmethod
    def load(name: str, read: Callable[[str], dict], active: tuple[str, ...] = ()) -> Bundle:
        """A bundle from its parsed file {base, layers:[...], variants:{type:{schema, overlays}}}; read(name) gives parsed files."""
        if name in active:
            raise SchemaError(f"bundle {name} is its own base")
        spec = read(name)
        base = Bundle.load(spec["base"], read, (*active, name)) if spec.get("base") else None
        out = Bundle(base=base, repository=Repository(dict(base.repository.layers)) if base else Repository())
        for item in spec.get("layers", ()):
            out.repository.put(layer_from_json(read(item) if isinstance(item, str) else item))
        for type_name, v in spec.get("variants", {}).items():
            out.add(type_name, Variant(v["schema"], list(v.get("overlays", ()))))
        return out

    def add(self, type_name: str, variant: Variant) -> None:
        if type_name in self.variants or (self.base and self.base.variant(type_name)):
            raise SchemaError(f"duplicate variant {type_name}")
        self.variants[type_name] = variant

    def merge(self, other: Bundle) -> None:
        for k, v in other.variants.items():
            self.add(k, v)
        self.repository.layers.update(other.repository.layers)

    def variant(self, type_name: str) -> Variant | None:
        return self.variants.get(type_name) or (self.base.variant(type_name) if self.base else None)

    def layer(self, type_name: str) -> Layer | None:
        """The variant's schema with its overlays composed, not compiled."""
        if type_name in self._built:
            return self._built[type_name]
        v = self.variant(type_name)
        if v is None:
            return self.repository.get(type_name)
        out = self.repository.get(v.schema)
        if out is None:
            raise SchemaError(f"schema {v.schema} of {type_name} is not in the bundle")
        for o in v.overlays:
            overlay = self.repository.get(o)
            if overlay is None:
                raise SchemaError(f"overlay {o} of {type_name} is not in the bundle")
            out = compose(out, overlay)
        self._built[type_name] = out
        return out

    def compiled(self, type_name: str) -> Layer:
        found = self.layer(type_name)
        if found is None:
            raise SchemaError(f"no variant {type_name}")
        return compile_schema(found, self.layer)


def find_variant(bundles: list[Bundle], type_name: str) -> Layer:
    """The compiled variant from the one bundle that has it; more than one is ambiguous."""
    having = [b for b in bundles if b.variant(type_name)]
    if len(having) != 1:
        raise SchemaError(f"{type_name} is in {len(having)} bundles")
    return having[0].compiled(type_name)


def read_url(place: str) -> bytes:
    """The bytes of a file or URL."""
    if "://" in place:
        from urllib.request import urlopen

        with urlopen(place) as f:
            return f.read()
    with open(place, "rb") as f:
        return f.read()


def read_json_or_yaml(place: str) -> dict:
    """A parsed file or URL, JSON or YAML by its suffix."""
    raw = read_url(place)
    if place.endswith((".yaml", ".yml")):
        import yaml

        return yaml.safe_load(raw)
    return json.loads(raw)
