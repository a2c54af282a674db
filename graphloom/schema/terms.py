"""The annotation vocabulary: names, composition rules, and short forms.

Terms are known by their name below the vocabulary's namespace, as `Reference/fk`. Any number of
namespace prefixes can be registered; they are stripped from keys on reading.
"""

from __future__ import annotations

from dataclasses import dataclass, field

#: Term names by composition rule. Names not listed compose as sets.
OVERRIDE = """
entityIdFields entityId hash hash.sha1 hash.sha256 hash.sha512 Reference/fkValue Reference/fkFor Reference/fk Reference/label
Reference/dir Reference/linkNode Reference/multi Reference/ref Reference/target nsMap setValue compose attributeOverlays characterEncoding attributeName
conditional defaultValue format ingestAs asPropertyOf edgeLabel outputEdgeLabel propertyName valueType labeledAs include
namespace provenance/source uuid vs/context vs/contextExpr vs/valuesets vs/requestKeys vs/requestValues vs/request
vs/resultKeys vs/resultValues vs/resultContext transform/mapProperty transform/mapContext transform/source transform/sources
transform/provenance transform/valueExpr transform/valueExpr.first transform/valueExpr.all measure/unit measure/value
measure/useUnit measure/unitDomain measure/unitExpr measure/valueNodeExpr measure/unitNode measure/valueNode
validation/enumeration validation/const validation/json/format validation/pattern validation/required
xml/ns xml/valueAttr xml/attribute
""".split()
SET = "description transform/evaluate goTimeFormat momentTimeFormat".split()
NOCOMPOSE = "Schema Overlay attributeIndex nodeId typeDiscriminator".split()
ERROR = "entitySchema instanceOf schemaNodeId layer DocumentNode value has Object/attributes Object/attributeList Array/elements Composite/allOf Polymorphic/oneOf".split()
#: Short keys of schema files and the terms they stand for.
SHORT = {
    "ref": "Reference/ref", "dir": "Reference/dir", "fk": "Reference/fk", "target": "Reference/target", "multi": "Reference/multi", "linkNode": "Reference/linkNode",
    "referenceFKFor": "Reference/fkFor", "referenceDir": "Reference/dir", "referenceLinkNode": "Reference/linkNode", "referenceFK": "Reference/fk",
    "referenceLabel": "Reference/label", "referenceMulti": "Reference/multi", "source": "provenance/source",
    "xmlns": "xml/ns", "xmlattribute": "xml/attribute", "xmlvalueAttr": "xml/valueAttr",
    "vsContext": "vs/context", "vsContextExpr": "vs/contextExpr", "vsValuesets": "vs/valuesets", "vsRequestKeys": "vs/requestKeys", "vsRequestValues": "vs/requestValues",
    "vsResultKeys": "vs/resultKeys", "vsResultValues": "vs/resultValues", "vsRequest": "vs/request", "vsResultContext": "vs/resultContext",
    "measureUnit": "measure/unit", "measureValue": "measure/value", "measureUseUnit": "measure/useUnit", "measureUnitDomain": "measure/unitDomain",
    "measureUnitNode": "measure/unitNode", "measureValueNode": "measure/valueNode", "measureUnitExpr": "measure/unitExpr", "measureValueExpr": "measure/valueNodeExpr",
    "measure/valueExpr": "measure/valueNodeExpr", "required": "validation/required", "pattern": "validation/pattern", "jsonFormat": "validation/json/format",
    "validation/jsonFormat": "validation/json/format", "enumeration": "validation/enumeration", "const": "validation/const",
    "transformEvaluate": "transform/evaluate", "transformValueExpr": "transform/valueExpr", "transformValueExpr.first": "transform/valueExpr.first",
    "transformValueExpr.all": "transform/valueExpr.all", "transformMapProperty": "transform/mapProperty", "transformMapContext": "transform/mapContext",
    "transformSource": "transform/source", "transformSources": "transform/sources", "transformProvenance": "transform/provenance",
}
KINDS = ("Value", "Object", "Array", "Reference", "Composite", "Polymorphic")
#: Types of values and other spellings of them.
TYPE_ALIASES = {
    "xsd:integer": "xsd:int", "integer": "xsd:long", "int": "xsd:long", "long": "xsd:long", "ls:int": "xsd:long", "ls:integer": "xsd:long", "ls:long": "xsd:long",
    "float": "xsd:decimal", "double": "xsd:decimal", "ls:float": "xsd:decimal", "ls:double": "xsd:decimal", "decimal": "xsd:decimal",
    "xsd:float": "xsd:decimal", "xsd:double": "xsd:decimal", "boolean": "xsd:boolean", "date": "xsd:date", "dateTime": "xsd:dateTime",
}


@dataclass
class Term:
    name: str
    rule: str = "set"
    tags: tuple[str, ...] = ()


@dataclass
class Vocabulary:
    """Registry of terms and of the namespaces under which they may be written."""

    prefixes: tuple[str, ...] = ("ls:", "lsxml:", "lstransform:")
    terms: dict[str, Term] = field(default_factory=dict)

    def __post_init__(self):
        for rule, names in (("override", OVERRIDE), ("set", SET), ("nocompose", NOCOMPOSE), ("error", ERROR)):
            for name in names:
                self.terms.setdefault(name, Term(name, rule))

    def register(self, name: str, rule: str = "set", tags: tuple[str, ...] = ()) -> Term:
        self.terms[name] = Term(name, rule, tags)
        return self.terms[name]

    def namespace(self, prefix: str) -> None:
        self.prefixes += (prefix,)

    def name(self, key: str) -> str:
        """The term a key stands for."""
        for prefix in self.prefixes:
            if key.startswith(prefix):
                key = {"lsxml:": "xml/", "lstransform:": "transform/"}.get(prefix, "") + key[len(prefix) :]
                break
        return SHORT.get(key, key)

    def rule(self, name: str) -> str:
        return self.terms[name].rule if name in self.terms else "set"


VOCABULARY = Vocabulary()


@dataclass
class Meaning:
    """What a term does, as far as it does it; every part may be left out.

    compose(target, source): its composed value. compile_term(attribute): work on an attribute that
    bears it. compile_node(layer, attribute): work on an attribute that has it as a label.
    compile_edge(layer, attribute): work on an attribute that a label of it leads to. check(attribute,
    value column): whether a value passes, a null is given too. check_nodes(graph, attribute):
    (graph_id, node_id) of the nodes that fail. read and write(attribute, text column): the native
    value of a text, and its text. post_node(graph, attribute): the graph after ingestion of an
    attribute that bears it. post(graph): the graph after all of that.
    """

    compose: object = None
    compile_term: object = None
    compile_node: object = None
    compile_edge: object = None
    check: object = None
    check_nodes: object = None
    read: object = None
    write: object = None
    post_node: object = None
    post: object = None


#: term -> its meaning, for terms that users add.
MEANINGS: dict[str, Meaning] = {}


def define(term: str, rule: str = "set", **parts) -> Meaning:
    """Register a term with its rule of composition and what else it means."""
    VOCABULARY.register(term, rule)
    MEANINGS[term] = Meaning(**parts)
    return MEANINGS[term]
