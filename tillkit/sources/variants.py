"""Free-form JSON objects of a row (S3, X1, X20): ``variants``, ``additional_attributes``, ``metadata``.

They travel as JSON text and are stored as VARIANT, Spark's binary form, so
that a path is read without parsing the text again. A field that is missing,
or whose value is of another type, is NULL; text that is no JSON fails the
query, as a cast to JSONB does. A NULL object is the empty one (X20).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def encode(**fields: Column) -> Column:
    """S3: a JSON object of the given columns; NULL fields are left out."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))


def parsed(name: str) -> Column:
    """JSON text as VARIANT, under the same name."""
    return F.parse_json(F.coalesce(F.col(name), F.lit("{}"))).alias(name)


def field(name: str, path: str, kind: str) -> Column:
    """``name->>path`` of a VARIANT column as ``kind``; NULL if it is not there or not of that kind."""
    return F.try_variant_get(F.col(name), path, kind)


def as_json(name: str) -> Column:
    """A VARIANT column as JSON text, keys in order."""
    return F.to_json(F.col(name))
