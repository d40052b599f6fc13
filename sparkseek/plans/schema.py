"""The one table: keyed documents with a fixed core and two open maps of fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEXT_FIELDS = ["callsign", "origin", "destination", "aircraft_type"]
NUMBER_FIELDS = ["latitude", "longitude", "altitude", "velocity", "heading", "vertical_rate"]

DOCUMENT = T.StructType(
    [T.StructField("doc_key", T.StringType())]
    + [T.StructField(c, T.StringType()) for c in [*TEXT_FIELDS, "tenant_id"]]
    + [T.StructField("observed_at", T.LongType())]
    + [T.StructField(c, T.DoubleType()) for c in NUMBER_FIELDS]
    + [
        T.StructField("on_ground", T.BooleanType()),
        T.StructField("text", T.MapType(T.StringType(), T.StringType())),
        T.StructField("number", T.MapType(T.StringType(), T.DoubleType())),
    ]
)


def normalize(df: DataFrame) -> DataFrame:
    """All columns of DOCUMENT, in its order; what is absent or null becomes '', 0, false or an empty map."""
    defaults = {
        T.StringType(): F.lit(""),
        T.LongType(): F.lit(0).cast("long"),
        T.DoubleType(): F.lit(0.0),
        T.BooleanType(): F.lit(False),
    }
    out = []
    for f in DOCUMENT.fields:
        if isinstance(f.dataType, T.MapType):
            default = F.create_map().cast(f.dataType)
        else:
            default = defaults[f.dataType]
        own = F.coalesce(F.col(f.name).cast(f.dataType), default) if f.name in df.columns else default
        out.append(own.alias(f.name))
    return df.select(*out)


class Fields:
    """Names to columns. Who asks decides which built-in names count; all other names are looked up in a map."""

    FILTER_TEXT = {"doc_key", "tenant_id", *TEXT_FIELDS}
    FILTER_NUMBER = {"observed_at", *NUMBER_FIELDS}
    BOOLEAN = {"on_ground"}
    COUNT_TEXT = {"tenant_id", *TEXT_FIELDS}

    @staticmethod
    def filter_text(name: str) -> Column:
        """A missing field reads as ''."""
        return F.col(name) if name in Fields.FILTER_TEXT else F.coalesce(F.try_element_at("text", F.lit(name)), F.lit(""))

    @staticmethod
    def number(name: str) -> Column:
        """A missing field is null."""
        return F.col(name).cast("double") if name in Fields.FILTER_NUMBER else F.try_element_at("number", F.lit(name))

    @staticmethod
    def count_text(name: str) -> Column:
        """A missing field is null, so that it is not counted; the key is no built-in name here."""
        return F.col(name) if name in Fields.COUNT_TEXT else F.try_element_at("text", F.lit(name))


def searchable_text() -> Column:
    """What keyword search and embedding read: four built-in fields and all values of the text map."""
    return F.concat_ws(" ", *(F.col(c) for c in TEXT_FIELDS), F.map_values("text"))
