"""Requested output fields and upload checks."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from scanweave import constants as K
from scanweave.functions.text import let


def _words(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def upload_error(length: Column, mime: Column) -> Column:
    """First failing upload rule as text, NULL when the upload is acceptable.  An absent
    file has no length; an unknown (empty) type passes."""
    kind = F.lower(F.coalesce(mime, F.lit("")))
    return (
        F.when(length.isNull() | (length == 0), F.lit("No image provided."))
        .when(length > K.MAX_UPLOAD_BYTES, F.lit("Image too large. Max 10MB allowed."))
        .when((kind != "") & ~kind.isin(K.ALLOWED_MIME_TYPES), F.lit("Unsupported image format."))
    )


def parse_fields(payload: Column) -> Column:
    """Request payload to struct<fields, error>; exactly one of the two is NULL.  What several
    rules ask for is bound once, so that a payload is parsed once."""
    return let(F.trim(F.coalesce(payload, F.lit(""))), _read_payload)


def _read_payload(text: Column) -> Column:
    # The JSON reader stops after the first value; a payload with more behind it is no JSON.
    whole = (
        (text.startswith("[") & text.endswith("]"))
        | (text.startswith("{") & text.endswith("}"))
        | text.rlike(r'^"([^"\\]|\\.)*"$')
        | text.rlike(r"^(null|true|false|-?[0-9.eE+-]+)$")
    )

    def with_json(json):
        return let(F.schema_of_variant(json), lambda kind: let(_present(text, json, kind), with_items))

    def with_items(present):
        invalid = F.transform(
            F.filter(present, lambda i: ~i["is_text"] | ~i["value"].isin(K.OUTPUT_FIELDS)),
            lambda i: i["value"],
        )
        fields = F.array_distinct(F.transform(
            F.filter(present, lambda i: i["is_text"] & i["value"].isin(K.OUTPUT_FIELDS)),
            lambda i: i["value"],
        ))
        return let(F.struct(invalid.alias("invalid"), fields.alias("fields")), judged)

    def judged(b):
        invalid, fields = b["invalid"], b["fields"]
        error = (
            F.when(text == "", F.lit(None).cast("string"))
            .when(fields.isNull(), F.lit("Invalid fields payload."))
            .when(F.size(invalid) > 0,
                  F.concat(F.lit("Unsupported fields: "), F.array_join(invalid, ", ")))
            .when(~has_primary(fields), F.lit("Select at least one extraction field."))
        )
        return let(error, lambda e: F.struct(
            F.when(text == "", _words(K.OUTPUT_FIELDS)).when(e.isNull(), fields).alias("fields"),
            e.alias("error"),
        ))

    return let(F.try_parse_json(F.when(whole, text)), with_json)


def _present(text: Column, json: Column, kind: Column) -> Column:
    """Items of a payload that are not blank: struct<is_text, value>; NULL for no list of items."""
    listed = F.transform(
        F.try_variant_get(json, "$", "array<variant>"),
        lambda v: F.struct(
            (F.schema_of_variant(v) == "STRING").alias("is_text"),
            F.when(F.is_variant_null(v), F.lit("None"))
            .when(F.schema_of_variant(v) == "BOOLEAN", F.initcap(v.try_cast("string")))
            .otherwise(F.coalesce(v.try_cast("string"), F.to_json(v)))
            .alias("value"),
        ),
    )

    def as_items(values):
        return F.transform(values, lambda v: F.struct(F.lit(True).alias("is_text"), v.alias("value")))

    items = (
        F.when(kind.startswith("ARRAY"), listed)
        .when(kind == "STRING", as_items(F.array(F.try_variant_get(json, "$", "string"))))
        .when(kind.isNull(), as_items(F.split(text, ",")))
    )
    trimmed = F.transform(items, lambda i: F.struct(
        i["is_text"].alias("is_text"),
        F.when(i["is_text"], F.trim(i["value"])).otherwise(i["value"]).alias("value"),
    ))
    return F.filter(trimmed, lambda i: ~(i["is_text"] & (i["value"] == "")))


def selected_primary(fields: Column) -> Column:
    return F.array_intersect(_words(K.PRIMARY_FIELDS), fields)


def has_primary(fields: Column) -> Column:
    return F.arrays_overlap(_words(K.PRIMARY_FIELDS), fields)


def ordered_union(fields: Column, preferred: Column) -> Column:
    """Distinct fields, the preferred ones first and in the preferred order."""
    return F.array_distinct(F.concat(F.array_intersect(preferred, fields), fields))


def _engine_fields(fields: Column, table: dict) -> Column:
    lookup = F.create_map(*[v for k, fs in table.items() for v in (F.lit(k), _words(fs))])
    mapped = F.flatten(F.transform(selected_primary(fields), lambda f: F.try_element_at(lookup, f)))
    return let(mapped, lambda found: ordered_union(found, _words(K.ENGINE_FIELDS)))


def public_engine_fields(fields: Column) -> Column:
    return _engine_fields(fields, K.PUBLIC_ENGINE_FIELDS)


def required_engine_fields(fields: Column) -> Column:
    return _engine_fields(fields, K.REQUIRED_ENGINE_FIELDS)
