"""What goes to a model and what shape its reply has: templates filled from columns, JSON schemas reduced to known keys."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The mark of a variable; the keys of a schema that the model boundary accepts, those whose value maps names to
# schemas, and those whose value is taken as it is.
VARIABLE = r"\{\{\s*([A-Za-z_][A-Za-z0-9_]*)\s*\}\}"
KEYS = set("$id $defs $ref $anchor type format title description enum items prefixItems minItems maxItems minimum maximum anyOf oneOf properties additionalProperties required propertyOrdering".split())
NAMED, AS_IS = {"properties", "$defs"}, {"enum", "required", "propertyOrdering"}


def filled(template: Column, variables: Column) -> Column:
    """struct<text, missing, unused> of a template and a map of variables: marks are replaced in one pass, so that a mark inside a
    value stays; there is no text if variables are missing or unused (both sorted)."""
    wanted = F.array_distinct(F.regexp_extract_all(template, F.lit(VARIABLE)))
    given = F.map_keys(variables)
    missing, unused = F.array_sort(F.array_except(wanted, given)), F.array_sort(F.array_except(given, wanted))
    between = F.split(template, VARIABLE, -1)
    values = F.concat(F.transform(F.regexp_extract_all(template, F.lit(VARIABLE)), lambda n: F.element_at(variables, n)), F.array(F.lit("")))
    text = F.array_join(F.zip_with(between, values, lambda a, b: F.concat(a, b)), "")
    return F.struct(F.when((F.size(missing) == 0) & (F.size(unused) == 0), text).alias("text"), missing.alias("missing"), unused.alias("unused"))


def _children(key: str, value):
    """The value of a known key with every schema in it reduced."""
    if key in AS_IS:
        return value
    return {name: reduced(sub) for name, sub in value.items()} if key in NAMED else reduced(value)


def reduced(schema):
    """A JSON schema with known keys only; a constant becomes an enumeration of one."""
    if isinstance(schema, list):
        return list(map(reduced, schema))
    if not isinstance(schema, dict):
        return schema
    constant = {"enum": [schema["const"]]} if "const" in schema and "enum" not in schema else {}
    known = ((k, _children(k, v)) for k, v in schema.items() if k in KEYS)
    return dict(chain(constant.items(), known))


def reduced_schema(schema: Column) -> Column:
    """The same for a column of JSON texts."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([None if x is None else json.dumps(reduced(json.loads(x)), ensure_ascii=False) for x in texts])

    return run(schema)
