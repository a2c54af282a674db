"""Composition of a layer with an overlay."""

from __future__ import annotations

import warnings

from .layer import Attribute, Layer, SchemaError, rule_of
from .terms import MEANINGS


def _list(v) -> list:
    return list(v) if isinstance(v, list) else [v]


def set_union(a, b):
    """Union in order of first appearance; a single equal value stays single."""
    if not isinstance(a, list) and a == b:
        return a
    out = list(dict.fromkeys(_list(a) + _list(b)))
    return out


def list_append(a, b):
    return _list(a) + _list(b)


def compose_property(term: str, target, source, rule: str = ""):
    """The composed value of one term; either side may be None."""
    if target is None:
        return source
    if source is None:
        return target
    if term in MEANINGS and MEANINGS[term].compose and not rule:
        return MEANINGS[term].compose(target, source)
    rule = rule or rule_of(term)
    if rule == "set":
        return set_union(target, source)
    if rule == "list":
        return list_append(target, source)
    if rule == "override":
        return source
    if rule == "nocompose":
        return target
    if target == source:
        return target
    raise SchemaError(f"{term} cannot be composed")


def compose_properties(target: Attribute, source: Attribute, rule: str = "") -> None:
    for term, value in source.props.items():
        if term == "compose":
            continue
        target.props[term] = compose_property(term, target.props.get(term), value, rule)


def ns_map(pairs) -> list[tuple[str, str]]:
    out = []
    for p in pairs if isinstance(pairs, list) else [pairs]:
        items = p.split("->")
        if len(items) != 2:
            raise SchemaError(f"invalid nsMap: {p}")
        out.append((items[0].strip(), items[1].strip()))
    return out


def rename(text: str, pairs: list[tuple[str, str]]) -> str:
    """The first prefix that fits is replaced."""
    return next((new + text[len(old) :] for old, new in pairs if text.startswith(old)), text)


def _merge(target: Attribute, source: Attribute, layer_rule: str) -> None:
    kinds = {target.kind, source.kind} - {""}
    if len(kinds) > 1:
        raise SchemaError(f"{target.id}: {target.kind} cannot be composed with {source.kind}")
    target.labels += [x for x in source.labels if x not in target.labels]
    compose_properties(target, source, source.one("compose") or layer_rule)


def _fits(target: list[Attribute], source: list[Attribute], suffix: bool) -> bool:
    """Paths agree from the leaf up; the overlay's must reach the target's root unless suffixes will do."""
    for t, s in zip(reversed(target), reversed(source)):
        if t.id != s.id:
            return False
    return suffix or len(source) >= len(target)


def compose(target: Layer, overlay: Layer, suffix_paths: bool = False) -> Layer:
    """A copy of target with the overlay applied.

    Attribute overlays go by id alone; other attributes merge where id and path agree, and
    missing ones are added below their parent. suffix_paths: an overlay's path may be a suffix of
    the target's; otherwise such an attribute is skipped with a warning.
    """
    if overlay.kind != "Overlay":
        raise SchemaError(f"{overlay.id} is not an overlay")
    if target.value_type and overlay.value_type and target.value_type != overlay.value_type:
        raise SchemaError(f"{overlay.id} is for {overlay.value_type}, not {target.value_type}")
    out = target.copy()
    out.value_type = out.value_type or overlay.value_type
    rule = overlay.props.get("compose", "")
    if pairs := ns_map(overlay.props.get("nsMap", [])):
        for a in out.attributes():
            a.id = rename(a.id, pairs)
    for k, v in overlay.props.items():
        if k not in ("compose", "nsMap", "attributeOverlays"):
            out.props[k] = compose_property(k, out.props.get(k), v, rule)
    own = {a.id: a for a in out.overlays}
    for a in overlay.overlays:
        if a.id in own:
            _merge(own[a.id], a, rule)
        if found := out.find(a.id):
            _merge(found, a, rule)
    for a in overlay.attributes():
        found = out.find(a.id)
        if found is not None:
            if _fits(found.path(), a.path(), suffix_paths):
                _merge(found, a, rule)
            else:
                warnings.warn(f"{overlay.id}: the path of {a.id} differs; it is skipped", stacklevel=2)
            continue
        parent = out.find(a.parent.id) if a.parent else None
        if parent is None:
            if out.root is None and a.parent is None:
                out.root = Attribute(a.id, a.kind, dict(a.props), list(a.labels))
                continue
            raise SchemaError(f"{overlay.id}: {a.id} has no parent in {target.id}")
        parent.add(Attribute(a.id, a.kind, dict(a.props), list(a.labels)))
    return out
