"""Declared schemas of the engine's tables; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "array<string>": T.ArrayType(T.StringType()),
    "lines": T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("size", T.DoubleType())])),
}


def _schema(columns: str) -> T.StructType:
    """Columns as ``name type, ...``; unlike Spark's DDL parser this needs no session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (c.split() for c in columns.split(","))])


UNITS = _schema(
    "doc_id string, parent_doc_id string, source_file string, page_start int, page_end int, section string, block_type string, family string, stage string, indicator_code string, indicator_name string, hash string, text string"
)
CHUNKS = _schema(
    "chunk_id string, doc_id string, source_file string, page_start int, page_end int, family string, indicator_code string, indicator_name string, block_type string, chunk_index int, char_offset int, n_chars int, text string"
)
PAGES = _schema("page_num int, full_text string, lines lines")
GOLD = _schema("query string, relevant_indicator_codes array<string>, relevant_families array<string>")
TASKS = _schema("id string, phase string, title string, owner_cli string, status string, validated string, depends_on array<string>, test_cmd string")

#: Legal values of the unit columns.
SECTIONS = ("indicator", "metodologia")
BLOCK_TYPES = ("core", "formula", "example", "section")
FAMILIES = ("planeacion", "competencia/licitacion", "adjudicacion", "ejecucion/contrato", "metodologia")
INDICATOR_FAMILIES = FAMILIES[:4]
