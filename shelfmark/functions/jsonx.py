"""JSON reads in which a wrong shape is empty rather than an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def string_array(text: Column) -> Column:
    """Array of strings; anything that is not a JSON array reads as empty."""
    parsed = F.from_json(F.when(F.trim(text).startswith("["), text), "array<string>")
    return F.filter(F.coalesce(parsed, F.array().cast("array<string>")), lambda x: x.isNotNull())


def object_array(text: Column, fields: str) -> Column:
    """Array of objects with the given struct fields, empty when malformed."""
    parsed = F.from_json(F.when(F.trim(text).startswith("["), text), f"array<struct<{fields}>>")
    return F.coalesce(parsed, F.array().cast(f"array<struct<{fields}>>"))


def object_map(text: Column) -> Column:
    """Flat object as map<string,string>, empty when malformed."""
    parsed = F.from_json(F.when(F.trim(text).startswith("{"), text), "map<string,string>")
    return F.coalesce(parsed, F.create_map().cast("map<string,string>"))


def path(text: Column, json_path: str) -> Column:
    return F.get_json_object(text, json_path)


def kind(text: Column) -> Column:
    """JSON type name of a value: object, array, string, number, boolean, null."""
    head = F.substring(F.trim(text), 1, 1)
    return (
        F.when(head == "{", "object")
        .when(head == "[", "array")
        .when(head == '"', "string")
        .when(F.trim(text).isin("true", "false"), "boolean")
        .when(F.trim(text) == "null", "null")
        .when(F.trim(text).rlike(r"^-?\d"), "number")
    )


def known_leaves(text: Column, schema: str, *getters) -> Column:
    """Concatenate the string leaves of a document of known shape.

    ``getters`` take the parsed struct and return string columns; open shapes go through
    ``udfs.json_leaves``.
    """
    parsed = F.from_json(text, schema)
    return F.concat_ws(" ", *[getter(parsed) for getter in getters])
