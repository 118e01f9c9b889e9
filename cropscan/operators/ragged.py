"""Documents and labels whose names are not known beforehand."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scaling import SCENE
from .timeseries import label_table

#: Names become columns, so there is a bound on them; more of them stop the query.
MOST_NAMES = 1_000

_PLAIN = {"BIGINT": "bigint", "DOUBLE": "double", "FLOAT": "double", "BOOLEAN": "boolean", "STRING": "string"}


def _names(found: DataFrame, what: str, most: int) -> list:
    rows = found.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} {what}")
    return rows


def exploded(documents: DataFrame, by: Sequence[str], text: str = "text") -> DataFrame:
    """(by, key, value): the fields of every document that is a JSON object, with their values as variants.

    Broken texts, nulls and other JSON have no fields.
    """
    parsed = documents.select(*by, F.try_parse_json(text).alias("document"))
    keys = ", ".join(f"`{c}`" for c in by)
    return documents.sparkSession.sql(
        f"SELECT {keys}{', ' * bool(by)}key, value FROM {{parsed}}, LATERAL variant_explode(document) WHERE key IS NOT NULL", parsed=parsed)


def fields_found(documents: DataFrame, text: str = "text", most: int = MOST_NAMES) -> dict[str, str]:
    """The top-level fields of all documents by name, with the type that holds every value, read from the data.

    Numbers with a fraction anywhere are doubles. Fields of several kinds, and nested ones, are their JSON text.
    """
    kinds = exploded(documents, [], text).groupBy("key").agg(F.schema_of_variant_agg("value").alias("kind"))
    rows = _names(kinds, "fields", most)
    return {r["key"]: "double" if r["kind"].startswith("DECIMAL") else _PLAIN.get(r["kind"], "json") for r in sorted(rows)}


def field(document: Column, name: str, kind: str) -> Column:
    """A field of a parsed document as ``kind``; null where it is absent. A path has no name with both quotes."""
    quote = '"' if "'" in name else "'"
    if quote in name:
        raise ValueError(f"no path leads to {name}")
    at = f"$[{quote}{name}{quote}]"
    if kind == "json":
        return F.to_json(F.try_variant_get(document, at, "variant"))
    return F.try_variant_get(document, at, kind)


def with_fields(
    documents: DataFrame, text: str = "text", fields: dict[str, str] | None = None
) -> DataFrame:
    """The documents with a column for each of ``fields``, by default for every field that any of them has."""
    fields = fields_found(documents, text) if fields is None else fields
    taken = {c.lower() for c in documents.columns}
    if clash := [name for name in fields if name.lower() in taken]:
        raise ValueError(f"fields with the name of a column: {clash}")
    parsed = documents.withColumn("_document", F.try_parse_json(text))
    columns = [field(F.col("_document"), name, kind).alias(name) for name, kind in fields.items()]
    return parsed.select(*(F.col(f"`{c}`") for c in documents.columns), *columns)


def with_metadata(scenes: DataFrame, documents: DataFrame, text: str = "text") -> DataFrame:
    """Scenes with every field of their metadata document, null where there is none.

    Of several documents of a scene the one whose text comes last counts.
    """
    one = documents.groupBy(*SCENE).agg(F.max(text).alias(text))
    return scenes.join(with_fields(one, text).drop(text), list(SCENE), "left")


def labels_found(rows: DataFrame, label: str, most: int = MOST_NAMES) -> list[str]:
    """The different labels in order; null is none."""
    found = rows.select(label).filter(F.col(label).isNotNull()).distinct()
    return sorted(r[0] for r in _names(found, "labels", most))


def label_table_found(rows: DataFrame, by: str, label: str, other: str = "Other") -> DataFrame:
    """``label_table`` with a column for every label there is; ``other`` counts rows without one."""
    return label_table(rows, by, label, labels_found(rows, label), other)


def tallies(documents: DataFrame, by: str, text: str = "text") -> DataFrame:
    """(by, label, count) from documents that map labels to counts; values that are no number are left out."""
    count = F.try_variant_get("value", "$", "bigint")
    rows = exploded(documents, [by], text).select(by, F.col("key").alias("label"), count.alias("n"))
    return rows.filter(F.col("n").isNotNull()).groupBy(by, "label").agg(F.sum("n").alias("count"))
