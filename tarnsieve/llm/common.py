"""What the operators share: names that don't clash, units of rows, joins of a checked size, the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t

from tarnsieve.shared import BROADCAST_BYTES, cut, fresh_dir, remove, shared_dir  # noqa: F401  the operators have them from here

#: What a unit (two longs and a count) takes in a broadcast relation, generously.
UNIT_BYTES = 48


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def free_name(df: DataFrame, base: str) -> str:
    """base, with underscores added until no column of df has that name (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


class Plain:
    """A table whose columns are called c0_, c1_, ... so that no name of its own (dots, backticks, doubles) can harm.

    col() finds a column by its own name, without case, the first of equal ones; back() gives a table that still has these columns
    their own names again, in their order.
    """

    def __init__(self, df: DataFrame):
        self.own, self.names = df.columns, [f"c{i}_" for i in range(len(df.columns))]
        self.df = df.toDF(*self.names)
        self.types = [f.dataType for f in df.schema.fields]
        self._at: dict[str, str] = {}
        for own, name in zip(self.own, self.names):
            self._at.setdefault(own.lower(), name)

    def col(self, own: str) -> Column:
        return F.col(self._at[own.lower()])

    def long(self, own: str) -> Column:
        """As a long; what is no whole number is null, and so is anything but a number or a string."""
        name = self._at[own.lower()]
        c, kind = F.col(name), self.types[self.names.index(name)]
        if isinstance(kind, (t.FractionalType, t.DecimalType)):
            return F.when(c == F.floor(c), c.try_cast("long"))
        return c.try_cast("long") if isinstance(kind, (t.IntegralType, t.StringType)) else F.lit(None).cast("long")

    def back(self, df: DataFrame, *added: str) -> DataFrame:
        return df.select(*self.names, *added).toDF(*self.own, *added)


def picked(df: DataFrame, *names: str) -> DataFrame:
    """These columns alone, under these names; doc_id, item_id and page_id as longs (what is no whole number is null), the rest but text as they are."""
    p = Plain(df)
    return p.df.select(*((p.long(n) if n.endswith("_id") else p.col(n)).alias(n) for n in names))


def text_key(text: Column | str = "text") -> Column:
    """64 bits that stand for a text; with the doc_id they name a unit."""
    return F.xxhash64(F.col(text) if isinstance(text, str) else text)


def units_of(docs: DataFrame) -> DataFrame:
    """doc_id, text and the unit's key k, under these very names, whatever else docs has."""
    return picked(docs, "doc_id", "text").withColumn("k", text_key())


def _sized(units: DataFrame, limit: int) -> DataFrame:
    """units for a join: broadcast where its counted size allows it, else left to a shuffle."""
    return F.broadcast(units) if units.count() * UNIT_BYTES <= limit else units


def _joined(docs: DataFrame, units: DataFrame, how: str, limit: int | None) -> DataFrame:
    p = Plain(docs)
    ref = units.select(F.col("k").alias("u_k"), F.col("doc_id").alias("u_i"))
    ref = ref if limit is None else _sized(ref, limit)
    on = (text_key(p.col("text")) == F.col("u_k")) & p.long("doc_id").eqNullSafe(F.col("u_i"))
    return p.back(p.df.join(ref, on, how))


def without_units(docs: DataFrame, units: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """docs without the rows of the given units (doc_id, k). units should be cut(): it is counted first."""
    return _joined(docs, units, "left_anti", limit)


def only_units(docs: DataFrame, units: DataFrame, limit: int | None = BROADCAST_BYTES) -> DataFrame:
    """The rows of docs that belong to the given units."""
    return _joined(docs, units, "left_semi", limit)


def by_size(table: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """table (cut()) marked for a broadcast where its counted size allows it."""
    return F.broadcast(table) if table.count() * row_bytes <= limit else table


def sortable(column: Column, kind) -> Column:
    """What rows can be sorted by: types without an order by their JSON text, with map keys in order."""
    def orderless(x) -> bool:
        if isinstance(x, t.ArrayType):
            return orderless(x.elementType)
        if isinstance(x, t.StructType):
            return any(orderless(f.dataType) for f in x.fields)
        return isinstance(x, (t.MapType, t.VariantType))

    def entries(c: Column, x) -> Column:
        if isinstance(x, t.MapType) and not orderless(x.keyType):
            return F.array_sort(F.transform(F.map_entries(c), lambda e: F.to_json(F.struct(e["key"].alias("k"), entries(e["value"], x.valueType).alias("v")))))
        if isinstance(x, t.ArrayType) and orderless(x):
            return F.transform(c, lambda e: entries(e, x.elementType))
        if isinstance(x, t.StructType) and orderless(x):
            return F.struct(*(entries(c.getField(f.name), f.dataType).alias(f"f{i}") for i, f in enumerate(x.fields)))
        return c

    return F.to_json(F.struct(entries(column, kind).alias("v"))) if orderless(kind) else column
