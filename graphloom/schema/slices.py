"""Projection of a layer onto some of its terms."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from .layer import Attribute, Layer


def by_terms(terms: Sequence[str], all_attributes: bool = False) -> Callable[[Attribute], dict | None]:
    """Keep the given terms; an attribute without any is dropped unless all_attributes."""
    wanted = set(terms)

    def pick(a: Attribute) -> dict | None:
        props = {k: v for k, v in a.props.items() if k in wanted}
        return props if props or all_attributes else None

    return pick


def slice_layer(layer: Layer, pick: Callable[[Attribute], dict | None], kind: str = "Overlay") -> Layer:
    """A layer of the attributes that pick keeps, with the ancestors they need."""

    def walk(a: Attribute) -> Attribute | None:
        props = pick(a)
        kept = [c for c in map(walk, a.children) if c is not None]
        if props is None and not kept:
            return None
        out = Attribute(a.id, a.kind, dict(props or {}), list(a.labels))
        for c in kept:
            out.add(c)
        return out

    return Layer(layer.id, kind, layer.value_type, walk(layer.root) if layer.root else None, {k: v for k, v in layer.props.items() if k != "layer"})
