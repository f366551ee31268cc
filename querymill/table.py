"""A typed table over a DataFrame: column kinds, analyzers and key."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Column kinds and their Spark types; each has an array variant named <kind>_array.
KINDS: dict[str, T.DataType] = {
    "integer": T.LongType(), "unsigned": T.DecimalType(20, 0), "real": T.DoubleType(), "text": T.StringType(), "boolean": T.BooleanType(),
    "date": T.DateType(), "date_time": T.TimestampType(), "timestamp": T.TimestampNTZType(), "blob": T.BinaryType(), "ip": T.BinaryType(),
    "json": T.StringType(), "facet": T.StringType(), "geo_point": T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())]),
}
RESERVED = "__qm_"
#: A table up to this size may sit in fewer row groups than there are cores: it is dealt to all before its text is cut.
SMALL_BYTES = 1 << 30


class RequestError(ValueError):
    """A request that the table cannot answer."""


def kind_of(data_type: T.DataType) -> str:
    if isinstance(data_type, T.ArrayType):
        return kind_of(data_type.elementType) + "_array"
    if isinstance(data_type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integer"
    if isinstance(data_type, T.StructType) and {f.name for f in data_type.fields} == {"lat", "lon"}:
        return "geo_point"
    for kind, spark in KINDS.items():
        if type(spark) is type(data_type) and kind not in ("ip", "json", "facet"):
            return kind
    return "real" if isinstance(data_type, (T.FloatType, T.DecimalType)) else "text"


@dataclass(frozen=True)
class ColumnDef:
    """One column: its kind, whether it may be null, and how its text is cut into tokens (text only)."""

    name: str
    kind: str
    nullable: bool = True
    analyzer: dict | str | None = None
    indexed: bool = True
    record: str = "positions"

    @property
    def is_array(self) -> bool:
        return self.kind.endswith("_array")

    @property
    def scalar(self) -> str:
        return self.kind.removesuffix("_array")

    def data_type(self) -> T.DataType:
        base = KINDS[self.scalar]
        return T.ArrayType(base) if self.is_array else base


@dataclass(frozen=True)
class Table:
    """A DataFrame with the columns' definitions. Names are looked up without regard to case."""

    name: str
    df: DataFrame
    columns: dict[str, ColumnDef]
    key: str
    #: Columns of token arrays kept beside the table (see with_tokens), by text column.
    token_columns: dict[str, str] = field(default_factory=dict)

    @staticmethod
    def of(df: DataFrame, key: str, name: str = "table", kinds: dict[str, str] | None = None, analyzers: dict | None = None) -> Table:
        kinds, analyzers = kinds or {}, analyzers or {}
        columns = {}
        for f in df.schema.fields:
            kind = kinds.get(f.name) or kind_of(f.dataType)
            columns[f.name] = ColumnDef(f.name, kind, f.nullable, analyzers.get(f.name, "default" if kind.startswith("text") else None))
        return validated(Table(name, df, columns, key)).prepared()

    def column(self, name: str) -> ColumnDef:
        """The column's definition, by its name in any case."""
        if name in self.columns:
            return self.columns[name]
        for c in self.columns.values():
            if c.name.lower() == name.lower():
                return c
        raise RequestError(f"table {self.name} has no column {name}")

    def indexed(self, name: str) -> ColumnDef:
        c = self.column(name)
        if not c.indexed:
            raise RequestError(f"column {c.name} is not indexed")
        return c

    def with_df(self, df: DataFrame) -> Table:
        return replace(self, df=df)

    def prepared(self) -> Table:
        """With token columns for analyzers that run in Python, whose results cannot be made inside other expressions."""
        from querymill.functions.text import needs_python

        names = [c.name for c in self.columns.values() if c.scalar == "text" and needs_python(c.analyzer) and c.name not in self.token_columns]
        return self.with_tokens(*names) if names else self

    def with_tokens(self, *names: str) -> Table:
        """Keep token arrays as columns, so that later requests (on a cached or written table) don't tokenise again."""
        from querymill.functions.text import array_tokens, tokens

        df, kept = self.df, dict(self.token_columns)
        for n in names:
            c = self.column(n)
            kept[c.name] = f"{RESERVED}tokens_{c.name}"
            df = df.withColumn(kept[c.name], (array_tokens if c.is_array else tokens)(F.col(c.name), c.analyzer))
        return replace(self, df=df, token_columns=kept)

    def tokenised(self, *names: str) -> Table:
        """The same for one request. A filter on the tokens stays above the step that makes them, so each text is cut once."""
        from querymill.functions.text import array_tokens, parse_analyzer, tokens

        wanted = [c for c in map(self.column, dict.fromkeys(names)) if c.name not in self.token_columns and parse_analyzer(c.analyzer)[0] != "raw"]
        if not wanted:
            return self
        df, kept = self.df, dict(self.token_columns)
        if df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() <= SMALL_BYTES:
            df = df.repartition(df.sparkSession.sparkContext.defaultParallelism)
        for c in wanted:
            kept[c.name] = f"{RESERVED}tokens_{c.name}"
            made = (array_tokens if c.is_array else tokens)(F.col(c.name), c.analyzer)
            df = df.select("*", F.explode_outer(F.array(made)).alias(kept[c.name]))  # one row for each row
        return replace(self, df=df, token_columns=kept)

    def tokens(self, name: str) -> Column:
        from querymill.functions.text import array_tokens, tokens

        c = self.indexed(name)
        if c.scalar != "text":
            raise RequestError(f"column {c.name} is not a text column")
        if c.name in self.token_columns:
            return F.col(self.token_columns[c.name])
        return array_tokens(F.col(c.name), c.analyzer) if c.is_array else tokens(F.col(c.name), c.analyzer)

    def text_columns(self) -> list[str]:
        return [c.name for c in self.columns.values() if c.kind == "text" and c.indexed]


def validated(table: Table) -> Table:
    """The definition's rules: one integer or text key that is no array, analyzers on text alone, no reserved or repeated names."""
    seen = set()
    for c in table.columns.values():
        if c.name.startswith(RESERVED) or c.name == "_score":
            raise RequestError(f"the name {c.name} is reserved")
        if c.name.lower() in seen:
            raise RequestError(f"the name {c.name} is repeated")
        seen.add(c.name.lower())
        if c.scalar not in KINDS:
            raise RequestError(f"unknown column kind {c.kind}")
        if (c.analyzer is not None) != (c.scalar == "text"):
            raise RequestError(f"column {c.name}: text columns have an analyzer, others have none")
    if table.column(table.key).kind not in ("integer", "text"):
        raise RequestError("the key is one integer or text column")
    return table
