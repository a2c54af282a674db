"""Layers (schemas and overlays) as attribute trees."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from .terms import VOCABULARY


class SchemaError(ValueError):
    pass


@dataclass(eq=False)
class Attribute:
    """A schema attribute: one of the six kinds, with properties (string or list of strings)."""

    id: str
    kind: str
    props: dict = field(default_factory=dict)
    labels: list[str] = field(default_factory=list)
    children: list[Attribute] = field(default_factory=list)
    parent: Attribute | None = None

    def add(self, child: Attribute) -> Attribute:
        child.parent = self
        self.children.append(child)
        return child

    def walk(self, seen: set | None = None) -> Iterator[Attribute]:
        """This attribute and all below, depth first; a shared (cyclic) attribute comes once."""
        seen = set() if seen is None else seen
        if id(self) in seen:
            return
        seen.add(id(self))
        yield self
        for c in self.children:
            yield from c.walk(seen)

    def path(self) -> list[Attribute]:
        out, at = [self], self.parent
        while at is not None and at not in out:
            out.append(at)
            at = at.parent
        return out[::-1]

    def one(self, term: str, default: str = "") -> str:
        v = self.props.get(term, default)
        return (v[0] if v else default) if isinstance(v, list) else v

    def many(self, term: str) -> list[str]:
        v = self.props.get(term, [])
        return list(v) if isinstance(v, list) else [v]

    @property
    def name(self) -> str:
        return self.one("attributeName")

    def copy(self, fix: Callable[[str], str] = lambda s: s, made: dict | None = None) -> Attribute:
        made = {} if made is None else made
        if id(self) in made:
            return made[id(self)]
        out = made[id(self)] = Attribute(fix(self.id), self.kind, {k: list(v) if isinstance(v, list) else v for k, v in self.props.items()}, list(self.labels))
        for c in self.children:
            out.children.append(own := c.copy(fix, made))
            if own.parent is None:
                own.parent = out
        return out


@dataclass(eq=False)
class Layer:
    """A schema or overlay: its id, the type it describes, and the attribute tree."""

    id: str
    kind: str = "Schema"
    value_type: str = ""
    root: Attribute | None = None
    props: dict = field(default_factory=dict)
    overlays: list[Attribute] = field(default_factory=list)

    def attributes(self) -> Iterator[Attribute]:
        if self.root is not None:
            yield from self.root.walk()

    def find(self, id_: str) -> Attribute | None:
        return next((a for a in self.attributes() if a.id == id_), None)

    def first(self, test: Callable[[Attribute], bool]) -> Attribute | None:
        return next((a for a in self.attributes() if test(a)), None)

    def path_of(self, id_: str) -> list[str]:
        found = self.find(id_)
        return [a.id for a in found.path()] if found else []

    def by_name(self, parent: Attribute) -> dict[str, list[Attribute]]:
        out: dict[str, list[Attribute]] = {}
        for c in parent.children:
            out.setdefault(c.name, []).append(c)
        return out

    def entities(self) -> list[Attribute]:
        """Roots of entities: attributes that bear an entity schema."""
        return [a for a in self.attributes() if a.props.get("entitySchema")]

    def entity_of(self, attribute: Attribute) -> Attribute | None:
        return next((a for a in reversed(attribute.path()) if a.props.get("entitySchema")), None)

    def copy(self) -> Layer:
        return Layer(self.id, self.kind, self.value_type, self.root.copy() if self.root else None, dict(self.props), [a.copy() for a in self.overlays])

    @property
    def encoding(self) -> str:
        import codecs

        name = self.props.get("characterEncoding", "") or "utf-8"
        try:
            return codecs.lookup(name if isinstance(name, str) else name[0]).name
        except LookupError as e:
            raise SchemaError(f"unknown character encoding {name}") from e

    def rows(self) -> list[tuple]:
        """(layer_id, node_id, parent_id, path, labels, kind, ord, props) of every attribute, for a schema_nodes table."""
        out = []
        for a in self.attributes():
            order = a.parent.children.index(a) if a.parent is not None and a in a.parent.children else 0
            props = {k: v if isinstance(v, list) else [str(v)] for k, v in a.props.items()}
            out.append((self.id, a.id, a.parent.id if a.parent else None, [x.id for x in a.path()], a.labels, a.kind, order, props))
        return out


SCHEMA_NODES = "layer_id string, node_id string, parent_id string, path array<string>, labels array<string>, kind string, ord int, props map<string,array<string>>"


def process_labeled_as(layer: Layer) -> Layer:
    """labeledAs adds labels and goes away."""
    for a in layer.attributes():
        for label in a.many("labeledAs"):
            if label not in a.labels:
                a.labels.append(label)
        a.props.pop("labeledAs", None)
    return layer


def rule_of(term: str) -> str:
    return VOCABULARY.rule(term)
