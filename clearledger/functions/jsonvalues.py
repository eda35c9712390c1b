"""JSON values in, JSON values out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clearledger.functions.moments import iso_timestamp, iso_zoned_timestamp

# Fixed value: how the text of a JSON object begins.
OBJECT_START = r"^[ \t\n\r]*\{"

JSON_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)
JSON_SCALARS = (T.StringType, T.BooleanType, T.NullType, *JSON_NUMBERS)


def field(document: Column, name: str) -> Column:
    """A member of a VARIANT object; SQL NULL when absent."""
    return F.try_variant_get(document, f"$.{name}", "variant")


def text_of(value: Column) -> Column:
    return value.cast("string")


def begins_object(body: Column) -> Column:
    """Whether the text of a JSON document is an object's, without walking it."""
    return body.rlike(OBJECT_START)


def is_text(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value) == "STRING", F.lit(False))


def is_truthy(value: Column) -> Column:
    """False for absent, null, ``""``, ``[]``, ``{}``, ``0`` and ``false``.

    A first element settles the case of a list, however long it is.
    """
    kind = F.schema_of_variant(value)
    first = F.try_variant_get(value, "$[0]", "variant")
    by_kind = (
        F.when(kind.isin("VOID", "ARRAY<VOID>", "OBJECT<>"), False)
        .when(kind == "STRING", text_of(value) != "")
        .when(kind.startswith("OBJECT<"), True)
        .when(kind == "BOOLEAN", text_of(value) == "true")
        .otherwise(text_of(value).try_cast("double") != 0)
    )
    return F.when(value.isNull(), False).when(first.isNotNull(), True).otherwise(by_kind)


def _numbered(df: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """Columns by place, and for each name, as written, the place of its last column.

    Names may repeat or differ by case only, so nothing is looked up by name.
    """
    last = {name: i for i, name in enumerate(df.columns)}
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]), last


def collapse_duplicates(df: DataFrame) -> DataFrame:
    """Keep one column per name: the place of the first, the value of the last."""
    numbered, last = _numbered(df)
    return numbered.select(*[F.col(f"c{i}").alias(name) for name, i in last.items()])


def _nested(c: Column, kind: T.DataType, leaf) -> Column:
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _nested(x, kind.elementType, leaf))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, v: _nested(v, kind.valueType, leaf))
    if isinstance(kind, T.StructType):
        names = [f.name for f in kind.fields]
        if len({n.lower() for n in names}) < len(names):  # then fields are told apart by place only
            names = [f"f{i}" for i in range(len(names))]
            c = c.cast(T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, kind.fields, strict=True)]))
        fields = [
            _nested(c.getField(n), f.dataType, leaf).alias(f.name) for n, f in zip(names, kind.fields, strict=True)
        ]
        return F.when(c.isNotNull(), F.struct(*fields))
    return leaf(c, kind)


def _strict_leaf(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, JSON_SCALARS + (T.VariantType,)):
        return c
    if isinstance(kind, T.DecimalType):
        return c.cast("double")
    if isinstance(kind, T.TimestampNTZType):
        return iso_timestamp(c)
    if isinstance(kind, T.TimestampType):
        return iso_zoned_timestamp(c)
    if isinstance(kind, (T.DateType, T.TimeType)):
        return c.cast("string")
    raise TypeError(f"Object of type {kind.simpleString()} is not JSON serializable")


def _lenient_leaf(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, JSON_SCALARS + (T.VariantType,)):
        return c
    if isinstance(kind, T.TimestampNTZType):
        return iso_timestamp(c, " ")
    if isinstance(kind, T.TimestampType):
        return iso_zoned_timestamp(c, " ")
    return c.cast("string")


def _ready(df: DataFrame, leaf) -> DataFrame:
    kinds = [f.dataType for f in df.schema.fields]
    numbered, last = _numbered(df)
    return numbered.select(*[_nested(F.col(f"c{i}"), kinds[i], leaf).alias(name) for name, i in last.items()])


def json_ready(df: DataFrame, stringify: bool = False) -> DataFrame:
    """Give every column a type JSON knows.

    Dates and times become ISO text and decimals become doubles. What is left
    (intervals, binary) is an error, or text with ``stringify``, which also
    turns decimals and timestamps into plain text.
    """
    return _ready(df, _lenient_leaf if stringify else _strict_leaf)


def to_json_text(c: Column) -> Column:
    return F.to_json(c, {"ignoreNullFields": "false"})


def rows_as_json(df: DataFrame, stringify: bool = False, name: str = "row_json") -> DataFrame:
    """One JSON object per row, NULL fields included."""
    return json_ready(df, stringify).select(to_json_text(F.struct("*")).alias(name))
