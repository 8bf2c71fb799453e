"""Requests as JSON text: parsed by one schema, with every reason for a rejection, in one pass."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clipgrain.sources import reference_data as R


class Field(NamedTuple):
    """A text field of a request: where it lies, whether it must be there, may be null, and which values it takes."""

    path: str
    required: bool = False
    nullable: bool = True
    allowed: tuple[str, ...] = ()


# The request's fields.
PURPOSES = (*R.CLIP_PURPOSES, "other")
DEFAULT_FORMAT = "webm"
FIELDS = (
    Field("audio_base64", required=True, nullable=False),
    Field("format", nullable=False),
    Field("expected_language"),
    Field("claimed_language"),
    Field("clip_purpose", allowed=PURPOSES),
)
NESTED = {"transcript": (Field("format", required=True, nullable=False), Field("content", required=True, nullable=False), Field("expected_language"))}

_CORRUPT = "_corrupt"


def schema() -> T.StructType:
    text = lambda fields: [T.StructField(f.path, T.StringType()) for f in fields]
    inner = [T.StructField(name, T.StructType(text(fields))) for name, fields in NESTED.items()]
    return T.StructType([*text(FIELDS), *inner, T.StructField(_CORRUPT, T.StringType())])


def _kind(json: Column, path: str) -> Column:
    """The JSON type at a path: OBJECT<...>, STRING, BIGINT, VOID for a JSON null; null where there is nothing."""
    return F.schema_of_variant(F.try_variant_get(json, path, "variant"))


def _faults(json: Column, fields: tuple[Field, ...], within: str, parsed: Column) -> list[Column]:
    """For each field one of missing, string_type and literal_error, or null."""
    found = []
    for f in fields:
        name = f"{within}.{f.path}" if within else f.path
        kind = _kind(json, f"$.{name}")
        rule = F.when(kind.isNull(), F.lit("missing") if f.required else F.lit(None)).when((kind == "VOID") & F.lit(f.nullable), None)
        if f.allowed:
            rule = rule.when((kind != "STRING") | ~parsed[f.path].isin(*f.allowed), "literal_error")
        else:
            rule = rule.when(kind != "STRING", "string_type")
        found.append(F.when(rule.isNotNull(), F.concat(F.lit(f"{name}: "), rule)))
    return found


def validated(requests: DataFrame, column: str = "request") -> DataFrame:
    """Adds ``parsed`` (a struct by ``schema``, defaults filled in), ``reasons`` and ``accepted``.

    ``reasons`` names each fault by place and kind, in the schema's order; what is no
    JSON object at all has that as its one reason, and null requests are such. Fields
    that the schema lacks are ignored. A rejected row keeps its text for the sender.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    rows = requests.withColumns({"_json": F.try_parse_json(F.col(column)), "parsed": F.from_json(F.col(column), schema(), options)})
    top, parsed = _kind(F.col("_json"), "$"), F.col("parsed")
    faults = _faults(F.col("_json"), FIELDS, "", parsed)
    for name, fields in NESTED.items():
        kind = _kind(F.col("_json"), f"$.{name}")
        whole = kind.startswith("OBJECT")
        faults.append(F.when(kind.isNotNull() & (kind != "VOID") & ~whole, f"{name}: model_type"))
        faults += [F.when(whole, c) for c in _faults(F.col("_json"), fields, name, parsed[name])]
    reasons = F.when(F.col("_json").isNull(), F.array(F.lit("request: json_invalid"))).when(~top.startswith("OBJECT"), F.array(F.lit("request: model_type"))).otherwise(F.array_compact(F.array(*faults)))
    rows = rows.withColumn("reasons", reasons).withColumn("accepted", F.size("reasons") == 0)
    filled = F.struct(*[(F.coalesce(parsed[f.path], F.lit(DEFAULT_FORMAT)) if f.path == "format" else parsed[f.path]).alias(f.path) for f in FIELDS], *[parsed[n].alias(n) for n in NESTED])
    return rows.withColumn("parsed", F.when(F.col("accepted"), filled)).drop("_json")


def accepted(rows: DataFrame) -> DataFrame:
    """The requests that are whole, their fields side by side."""
    own = [c for c in rows.columns if c not in ("parsed", "reasons", "accepted", "request")]
    return rows.where("accepted").select(*own, "parsed.*")


def rejected(rows: DataFrame) -> DataFrame:
    return rows.where("not accepted").drop("parsed", "accepted")
