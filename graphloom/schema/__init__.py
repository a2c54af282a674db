"""Schemas, overlays and their algebra. All of it runs on the driver: schemas are small."""

from .bundle import Bundle, Repository
from .compiler import compile_schema
from .compose import compose
from .layer import Attribute, Layer, SchemaError
from .reader import layer_from_json, layer_to_json
from .slices import slice_layer

__all__ = ["Attribute", "Bundle", "Layer", "Repository", "SchemaError", "compile_schema", "compose", "layer_from_json", "layer_to_json", "slice_layer"]
