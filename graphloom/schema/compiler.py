"""Compilation: includes, references and compositions are resolved into one attribute graph."""

from __future__ import annotations

from collections.abc import Callable

from .compose import compose_properties
from .layer import Attribute, Layer, SchemaError, process_labeled_as
from .terms import MEANINGS

#: term -> function(attribute): called once for each attribute that bears the term.
TERM_COMPILERS: dict[str, Callable[[Attribute], None]] = {}
#: function(layer, attribute), called for each attribute after everything else.
NODE_COMPILERS: list[Callable[[Layer, Attribute], None]] = []


def compile_schema(schema: Layer, load: Callable[[str], Layer | None] = lambda ref: None) -> Layer:
    """A self-contained copy of schema. load gives the schema of a reference or include.

    References to the same schema share attributes, so recursive schemas become cyclic graphs;
    plans over them need a depth (Layer walks visit each attribute once).
    """
    out = schema.copy()
    if out.root is None:
        raise SchemaError(f"{schema.id} has no attributes")
    _check_ids(out)
    entity = out.value_type or out.id
    out.root.props.setdefault("entitySchema", schema.id)
    if entity not in out.root.labels:
        out.root.labels.append(entity)
    _includes(out, load)
    _references(out, load, {schema.id: out.root, **({schema.value_type: out.root} if schema.value_type else {})})
    _compositions(out)
    process_labeled_as(out)
    for a in out.attributes():
        for term, work in TERM_COMPILERS.items():
            if term in a.props:
                work(a)
        for work in NODE_COMPILERS:
            work(out, a)
        for term, m in MEANINGS.items():
            if m.compile_term and term in a.props:
                m.compile_term(a)
            if m.compile_node and term in a.labels:
                m.compile_node(out, a)
            if m.compile_edge and term in (a.one("edgeLabel"), a.one("outputEdgeLabel"), a.one("Reference/label")):
                m.compile_edge(out, a)
    return out


def _check_ids(layer: Layer) -> None:
    seen: set[str] = set()
    for a in layer.attributes():
        if a.id in seen:
            raise SchemaError(f"duplicate attribute id {a.id}")
        seen.add(a.id)


def _schema(load, ref: str) -> Layer:
    found = load(ref)
    if found is None or found.root is None:
        raise SchemaError(f"schema not found: {ref}")
    return found


def _includes(layer: Layer, load) -> None:
    while a := layer.first(lambda x: "include" in x.props):
        ref, space = a.one("include"), a.one("namespace")
        a.props.pop("include")
        a.props.pop("namespace", None)
        included = _schema(load, ref).root
        if included.kind != a.kind:
            raise SchemaError(f"{a.id} is {a.kind}, but {ref} is {included.kind}")
        fix = (lambda s: space + s[s.rindex("/") :] if "/" in s else s) if space else (lambda s: s)  # noqa: B023
        copy = included.copy(fix)
        compose_properties(a, copy)
        a.labels += [x for x in copy.labels if x not in a.labels]
        for c in copy.children:
            a.add(c)


def _references(layer: Layer, load, roots: dict[str, Attribute]) -> None:
    """A reference becomes its target: labels, properties and children. Roots once resolved are shared."""
    while a := layer.first(lambda x: x.kind == "Reference" and "Reference/ref" in x.props and not x.props.get("_done")):
        ref = a.one("Reference/ref")
        if ref not in roots:
            found = _schema(load, ref)
            root = found.root.copy()
            root.props.setdefault("entitySchema", found.id)
            if found.value_type and found.value_type not in root.labels:
                root.labels.append(found.value_type)
            roots[ref] = root
        target = roots[ref]
        if "Reference/dir" in a.props:  # a link: it stays a reference, and its target is not embedded
            a.props["_done"] = "link"
            continue
        a.kind = target.kind
        a.labels += [x for x in target.labels if x not in a.labels]
        own = dict(a.props)
        for term, value in target.props.items():
            a.props.setdefault(term, value)
        a.props.update({k: v for k, v in own.items() if k != "Reference/ref"})
        a.props["Reference/ref"] = ref
        a.props["_done"] = "embedded"
        a.children = list(target.children)
        for c in a.children:
            c.parent = c.parent if c.parent is not None and c.parent is not target else a
    for a in layer.attributes():
        a.props.pop("_done", None)


def _compositions(layer: Layer) -> None:
    """allOf parts merge: the parts of objects move up, other parts become attributes."""
    while a := layer.first(lambda x: x.kind == "Composite"):
        parts, a.children = a.children, []
        kinds = set()
        queue = list(parts)
        while queue:
            part = queue.pop(0)
            if part.kind == "Composite":
                queue = part.children + queue
            elif part.kind == "Object":
                compose_properties(a, part)
                a.labels += [x for x in part.labels if x not in a.labels]
                for c in part.children:
                    a.add(c)
                kinds.add("Object")
            else:
                a.add(part)
                kinds.add("Object")
        a.kind = "Object"
