"""Explicit schemas: no inference pass over a corpus."""

RESPONSE = """
  model STRING,
  usage STRUCT<pages: INT>,
  content STRUCT<html: STRING, markdown: STRING, text: STRING>,
  elements ARRAY<STRUCT<
    category: STRING,
    page: INT,
    content: STRUCT<html: STRING, markdown: STRING, text: STRING>,
    coordinates: ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>>>
"""
NAMED = ("model", "usage", "content", "elements")
CORRUPT = "_corrupt_record"
RESPONSE_OR_CORRUPT = f"{RESPONSE}, {CORRUPT} STRING"
