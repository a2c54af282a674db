"""Layers from and to their JSON form (the in-tree context's short keys, or prefixed terms)."""

from __future__ import annotations

from .jsonld import embed
from .layer import Attribute, Layer, SchemaError
from .terms import KINDS, VOCABULARY

_CHILDREN = {"attributes": "Object", "attributeList": "Object", "Object/attributes": "Object", "Object/attributeList": "Object", "arrayElements": "Array", "Array/elements": "Array", "allOf": "Composite", "Composite/allOf": "Composite", "oneOf": "Polymorphic", "anyOf": "Polymorphic", "Polymorphic/oneOf": "Polymorphic"}
_OUT = {"Object": "attributeList", "Array": "arrayElements", "Composite": "allOf", "Polymorphic": "oneOf"}


def _value(v):
    """Scalars as strings, @value and @id unwrapped, @list and @set flattened."""
    if isinstance(v, dict):
        for k in ("@value", "@id"):
            if k in v:
                return _value(v[k])
        for k in ("@list", "@set"):
            if k in v:
                return _value(v[k])
        raise SchemaError(f"no property value: {v}")
    if isinstance(v, list):
        return [x for i in v for x in (lambda y: y if isinstance(y, list) else [y])(_value(i))]
    if isinstance(v, bool):
        return "true" if v else "false"
    return "" if v is None else str(v)


def _types(spec: dict) -> list[str]:
    t = spec.get("@type", [])
    return [VOCABULARY.name(x) for x in (t if isinstance(t, list) else [t])]


def attribute_from_json(spec: dict) -> Attribute:
    types = _types(spec)
    found = [t for t in types if t in KINDS]
    props: dict = {}
    children: list[Attribute] = []
    implied = set()
    for key, v in spec.items():
        if key in ("@id", "@type", "@context"):
            continue
        term = VOCABULARY.name(key)
        if key == "label" and "Reference" in types:
            term = "Reference/label"
        if key in _CHILDREN or term in _CHILDREN:
            implied.add(_CHILDREN.get(key) or _CHILDREN[term])
            if isinstance(v, dict) and "@list" in v:
                v = v["@list"]
            if isinstance(v, dict) and implied == {"Object"} and "@type" not in v:
                v = [{"@id": k, **x} for k, x in v.items()]
            children += [attribute_from_json(x) for x in (v if isinstance(v, list) else [v])]
        else:
            props[term] = _value(v)
    kinds = set(found) | implied
    if len(kinds) > 1:
        raise SchemaError(f"{spec.get('@id')}: more than one attribute type: {sorted(kinds)}")
    out = Attribute(spec.get("@id", ""), next(iter(kinds), ""), props, [t for t in types if t not in KINDS and t != "Attribute"])
    if out.kind == "Array" and len(children) > 1:
        raise SchemaError(f"{out.id}: an array has one element attribute")
    for k, c in enumerate(children):
        if not c.id:
            c.id = f"{out.id}/{c.name or k}"
        out.add(c)
    return out


def _plain(node: dict) -> dict:
    """An expanded node with short keys and single values out of their arrays."""
    out = {}
    for k, v in node.items():
        if k in ("@id", "@value"):
            out[k] = v
        elif k == "@type":
            out[k] = list(v)
        elif k == "@list":
            out[k] = [_plain(x) for x in v]
        else:
            own = [_plain(x) for x in v]
            out[VOCABULARY.name(k)] = own[0] if len(own) == 1 and VOCABULARY.name(k) not in _CHILDREN else own[0]["@list"] if len(own) == 1 and "@list" in own[0] else own
    return out


def layer_from_json(spec: dict) -> Layer:
    """A layer from a parsed JSON document.

    A document with a context of its own is expanded by it first, and nodes that it refers to
    are put in place; the namespaces of its terms must be known to the vocabulary. Without
    context, or with the name of one, the keys are the short ones.
    """
    contexts = spec.get("@context")
    if any(isinstance(c, dict) for c in (contexts if isinstance(contexts, list) else [contexts])):
        spec = _plain(embed(spec, kinds=("Schema", "Overlay")))
    types = _types(spec)
    kind = next((t for t in types if t in ("Schema", "Overlay")), None)
    if kind is None:
        raise SchemaError(f"{spec.get('@id')}: neither schema nor overlay")
    root, overlays, props, value_type = None, [], {}, ""
    for key, v in spec.items():
        if key in ("@id", "@type", "@context"):
            continue
        term = VOCABULARY.name(key)
        if term == "layer":
            root = attribute_from_json({"@id": v.get("@id", spec.get("@id", "")), **v})
        elif term == "attributeOverlays":
            overlays = [attribute_from_json(x) for x in (v["@list"] if isinstance(v, dict) and "@list" in v else v)]
        elif term == "valueType":
            value_type = _value(v)
        else:
            props[term] = _value(v)
    if root is not None:
        if not root.kind:
            root.kind = "Object"
        for a in root.walk():
            if not a.kind:
                if kind == "Schema":
                    raise SchemaError(f"{a.id}: no attribute type")
        for term in ("entityIdFields", "characterEncoding"):
            if term in props and term == "entityIdFields":
                root.props.setdefault(term, props[term])
    return Layer(spec.get("@id", ""), kind, value_type, root, props, overlays)


def attribute_to_json(a: Attribute) -> dict:
    out: dict = {"@id": a.id, "@type": [t for t in (a.kind, *a.labels) if t], **a.props}
    if a.children:
        own = [attribute_to_json(c) for c in a.children]
        out[_OUT.get(a.kind, "attributeList")] = own[0] if a.kind == "Array" else own
    return out


def layer_to_json(layer: Layer) -> dict:
    out: dict = {"@id": layer.id, "@type": layer.kind, **layer.props}
    if layer.value_type:
        out["valueType"] = layer.value_type
    if layer.root is not None:
        out["layer"] = attribute_to_json(layer.root)
    if layer.overlays:
        out["attributeOverlays"] = [attribute_to_json(a) for a in layer.overlays]
    return out


def layer_from_graph(spec: dict) -> Layer:
    """A layer from its serialized graph: {nodes:[{n,labels,properties,edges:[{to,label}]}]}."""
    nodes = {n["n"]: n for n in spec["nodes"]}
    edges: dict[int, list[tuple[str, int]]] = {}
    for n in spec["nodes"]:
        for e in n.get("edges", ()):
            edges.setdefault(n["n"], []).append((VOCABULARY.name(e["label"]), e["to"]))
    for e in spec.get("edges", ()):
        edges.setdefault(e["from"], []).append((VOCABULARY.name(e["label"]), e["to"]))
    props = lambda n: {VOCABULARY.name(k): _value(v) for k, v in n.get("properties", {}).items()}

    def attribute(k: int) -> Attribute:
        p = props(nodes[k])
        labels = [VOCABULARY.name(x) for x in nodes[k].get("labels", ())]
        out = Attribute(p.pop("nodeId", ""), next((x for x in labels if x in KINDS), ""), p, [x for x in labels if x not in KINDS and x != "Attribute"])
        below = [attribute(to) for label, to in edges.get(k, ()) if label in _CHILDREN]
        for c in sorted(below, key=lambda c: int(c.one("attributeIndex", "0"))):
            out.add(c)
        return out

    for k, n in nodes.items():
        labels = [VOCABULARY.name(x) for x in n.get("labels", ())]
        if "Schema" in labels or "Overlay" in labels:
            p = props(n)
            root = next((attribute(to) for label, to in edges.get(k, ()) if label == "layer"), None)
            return Layer(p.pop("nodeId", ""), "Schema" if "Schema" in labels else "Overlay", p.pop("valueType", ""), root, p)
    raise SchemaError("no layer in the graph")
