"""Schemas and value sets over the TPC-H-like tables that the registered queries use."""

from __future__ import annotations

from functools import cache

from .schema import compile_schema, layer_from_json
from .schema.layer import Layer


def flat_schema(name: str, attributes: dict[str, dict | str], **root) -> dict:
    """JSON of a schema: attribute id suffix to attribute name or to annotations (type Value unless said)."""
    listed = []
    for key, spec in attributes.items():
        own = {"attributeName": spec} if isinstance(spec, str) else dict(spec)
        listed.append({"@id": f"{name}/{key}", "@type": own.pop("@type", "Value"), **own})
    return {"@id": f"{name}/schema", "@type": "Schema", "valueType": name, "layer": {"@id": name, "@type": "Object", "attributeList": listed, **root}}


SCHEMAS = {
    "Customer": flat_schema("Customer", {"key": "c_custkey", "name": "c_name", "segment": "c_mktsegment"}, entityIdFields=["Customer/key"]),
    "CustomerHash": flat_schema("CustomerHash", {"key": "c_custkey", "name": "c_name", "hash": {"attributeName": "h", "hash.sha256": ["CustomerHash/key", "CustomerHash/name"]}}, entityIdFields=["CustomerHash/key"]),
    "CustomerSha1": flat_schema("CustomerSha1", {"key": "c_custkey", "name": "c_name", "hash": {"attributeName": "h", "hash.sha1": ["CustomerSha1/name"]}}, entityIdFields=["CustomerSha1/key"]),
    "CustomerProperty": flat_schema("CustomerProperty", {"key": "c_custkey", "name": {"attributeName": "c_name", "ingestAs": "property", "propertyName": "name"}}, entityIdFields=["CustomerProperty/key"]),
    "CustomerEdge": flat_schema("CustomerEdge", {"key": "c_custkey", "name": {"attributeName": "c_name", "ingestAs": "edge", "edgeLabel": "named"}}),
    "CustomerNone": flat_schema("CustomerNone", {"key": "c_custkey", "name": {"attributeName": "c_name", "ingestAs": "none"}}),
    "CustomerDefault": flat_schema("CustomerDefault", {"key": "c_custkey", "status": {"attributeName": "status", "defaultValue": "active"}}),
    "CustomerSet": flat_schema("CustomerSet", {"key": "c_custkey", "name": "c_name", "copy": {"attributeName": "copy", "setValue": ["match (this)<-[]-()-[]->(n {schemaNodeId:'CustomerSet/name'}) return n.value"]}}),
    "CustomerUuid": flat_schema("CustomerUuid", {"key": "c_custkey", "name": {"attributeName": "c_name", "uuid": "true"}}),
    "Supplier": flat_schema("Supplier", {"key": "s_suppkey", "name": "s_name", "nation": "s_nationkey"}, entityIdFields=["Supplier/nation"]),
    "Order": flat_schema(
        "Order",
        {
            "key": "o_orderkey",
            "cust": {"attributeName": "o_custkey", "referenceFKFor": "Customer", "dir": "to", "referenceLabel": "placedBy"},
            "priority": {"attributeName": "o_orderpriority", "vsValuesets": ["priority"], "vsRequestValues": ["Order/priority"], "vsResultValues": ["Order/code"]},
            "code": "priority_code",
            "status": {"attributeName": "o_orderstatus", "enumeration": ["F", "O"], "required": "true"},
        },
        entityIdFields=["Order/key"],
    ),
    "OrderFrom": flat_schema("OrderFrom", {"key": "o_orderkey", "cust": "o_custkey", "ref": {"@type": "Reference", "ref": "Customer", "fk": ["OrderFrom/cust"], "dir": "from", "label": "placed", "ingestAs": "edge"}}, entityIdFields=["OrderFrom/key"]),
    "OrderNode": flat_schema("OrderNode", {"key": "o_orderkey", "cust": "o_custkey", "ref": {"@type": "Reference", "attributeName": "customer", "ref": "Customer", "fk": ["OrderNode/cust"], "dir": "to", "label": "is"}}, entityIdFields=["OrderNode/key"]),
    "Line": flat_schema("Line", {"number": "l_linenumber", "order": "o_orderkey", "part": {"attributeName": "l_partkey", "referenceFKFor": "Part", "dir": "to", "referenceLabel": "of"}}, entityIdFields=["Line/order", "Line/number"]),
    "Part": flat_schema("Part", {"key": "p_partkey", "brand": {"attributeName": "p_brand", "pattern": "^Brand#[1-3]"}, "size": {"attributeName": "p_size", "valueType": "xsd:int"}}, entityIdFields=["Part/key"]),
    "PartSize": flat_schema("PartSize", {"key": "p_partkey", "size": {"attributeName": "size_text"}, "measure": {"@type": ["Value", "Measure"], "attributeName": "length", "measureValueNode": "PartSize/size", "measureUseUnit": "mm"}}),
    "PartUnit": flat_schema("PartUnit", {"key": "p_partkey", "size": "p_size", "unit": "unit", "measure": {"@type": ["Value", "Measure"], "attributeName": "length", "measureValueNode": "PartUnit/size", "measureUnitNode": "PartUnit/unit"}}),
    "Person": flat_schema("Person", {"id": {"attributeName": "id", "transformSource": "Customer/key"}, "label": {"attributeName": "label", "transformValueExpr": ["match (n {schemaNodeId:'Customer/name'}) return n"]}, "kind": {"attributeName": "kind", "transformValueExpr": ["return 'customer'"]}}),
    "Event": {"@id": "Event/schema", "@type": "Schema", "valueType": "Event", "layer": {"@id": "Event", "@type": "Object", "attributeList": [{"@id": "Event/k", "@type": "Value", "attributeName": "k", "valueType": "json:integer"}]}},
    "Conversation": {
        "@id": "Conversation/schema", "@type": "Schema", "valueType": "Conversation",
        "layer": {"@id": "Conversation", "@type": "Object", "attributeList": [
            {"@id": "Conversation/id", "@type": "Value", "attributeName": "id", "valueType": "json:integer"},
            {"@id": "Conversation/turns", "@type": "Array", "attributeName": "turns", "arrayElements": {"@id": "Conversation/turn", "@type": "Object", "attributeList": [
                {"@id": "Conversation/turn/n", "@type": "Value", "attributeName": "n", "valueType": "json:integer"}, {"@id": "Conversation/turn/role", "@type": "Value", "attributeName": "role"}]}}]},
    },
    "Choice": {
        "@id": "Choice/schema", "@type": "Schema", "valueType": "Choice",
        "layer": {"@id": "Choice", "@type": "Object", "attributeList": [{"@id": "Choice/item", "@type": "Polymorphic", "attributeName": "item", "oneOf": [
            {"@id": "Choice/click", "@type": "Object", "attributeList": [{"@id": "Choice/click/t", "@type": "Value", "attributeName": "t", "enumeration": ["click", "view"]}]},
            {"@id": "Choice/buy", "@type": "Object", "attributeList": [{"@id": "Choice/buy/t", "@type": "Value", "attributeName": "t", "enumeration": ["purchase"]}]}]}]},
    },
    "Region": {
        "@id": "Region/schema", "@type": "Schema", "valueType": "Region",
        "layer": {"@id": "Region", "@type": "Object", "attributeName": "region", "attributeList": [
            {"@id": "Region/key", "@type": "Value", "attributeName": "key", "xmlattribute": "true"}, {"@id": "Region/name", "@type": "Value", "attributeName": "name"},
            {"@id": "Region/alt", "@type": "Value", "attributeName": "alt", "xmlvalueAttr": "value"}]},
    },
}
PRIORITIES = [{"id": "priority", "values": [{"values": ["1-URGENT", "2-high"], "result": "H"}, {"values": ["3-MEDIUM"], "result": "M"}, {"result": "L"}]}]


@cache
def compiled(name: str) -> Layer:
    load = lambda ref: layer_from_json(SCHEMAS[ref]) if ref in SCHEMAS else None
    return compile_schema(layer_from_json(SCHEMAS[name]), load)
