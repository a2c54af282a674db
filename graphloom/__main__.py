"""Command line: python -m graphloom COMMAND ...; results go to standard output."""

from __future__ import annotations

import argparse
import json
import sys

from .schema import Bundle, compile_schema, compose, layer_from_json, layer_to_json, slice_layer
from .schema.bundle import find_variant, read_json_or_yaml
from .schema.jsonschema import import_json_schema
from .schema.slices import by_terms
from .schema.spreadsheet import layer_from_header


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("graphloom").getOrCreate()


def _layer(path: str):
    return layer_from_json(read_json_or_yaml(path))


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="graphloom")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("pipeline", help="run the steps of a JSON or YAML file")
    c.add_argument("file")
    c.add_argument("--bundle", help="bundle whose variants the steps name as type")
    c = sub.add_parser("compile", help="compile a schema, or a bundle's variant")
    c.add_argument("file", nargs="+", help="the schema, then schemas that it refers to; or bundles with --type")
    c.add_argument("--type")
    c = sub.add_parser("compose", help="a schema with overlays applied")
    c.add_argument("file", nargs="+")
    c = sub.add_parser("slice", help="the part of a layer that bears some terms")
    c.add_argument("file")
    c.add_argument("--term", action="append", required=True)
    c = sub.add_parser("header", help="a schema from a CSV header")
    c.add_argument("file")
    c.add_argument("--id", default="schema")
    c = sub.add_parser("jsonschema", help="layers from a JSON Schema document")
    c.add_argument("file")
    c.add_argument("--entity", action="append", required=True, help="name=#/pointer")
    c = sub.add_parser("query", help="an openCypher query over a graph JSON file")
    c.add_argument("file")
    c.add_argument("--expr", required=True)
    a = p.parse_args(args)
    show = lambda x: print(json.dumps(x, indent=2))
    if a.command == "compile":
        if a.type:
            show(layer_to_json(find_variant([Bundle.load(f, read_json_or_yaml) for f in a.file], a.type)))
        else:
            others = {x.value_type or x.id: x for x in map(_layer, a.file[1:])}
            show(layer_to_json(compile_schema(_layer(a.file[0]), others.get)))
    elif a.command == "compose":
        out = _layer(a.file[0])
        for f in a.file[1:]:
            out = compose(out, _layer(f))
        show(layer_to_json(out))
    elif a.command == "slice":
        show(layer_to_json(slice_layer(_layer(a.file), by_terms(a.term))))
    elif a.command == "header":
        import csv

        with open(a.file, encoding="utf-8", newline="") as f:
            show(layer_to_json(layer_from_header(next(csv.reader(f)), a.id)))
    elif a.command == "jsonschema":
        entities = {n: f"doc{ref}" for n, _, ref in (e.partition("=") for e in a.entity)}
        show({n: layer_to_json(x) for n, x in import_json_schema(entities, {"doc": read_json_or_yaml(a.file)}).items()})
    elif a.command == "query":
        from pyspark.sql import functions as F

        from .plans.cypher import run
        from .sources.graphs import read_graphs

        spark = _session()
        docs = spark.read.option("wholetext", True).text(a.file)
        for r in run(read_graphs(docs, "value", F.lit("g")), a.expr).toLocalIterator():
            print(json.dumps(r.asDict(recursive=True)))
    else:
        from .plans.pipeline import Context, run

        bundle = Bundle.load(a.bundle, read_json_or_yaml) if a.bundle else None
        out = run(a.file, Context(_session(), bundle=bundle))
        for name, value in out.results.items():
            print(f"{name}: {value if isinstance(value, str) else type(value).__name__}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
