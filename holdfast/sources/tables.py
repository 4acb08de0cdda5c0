"""The bundle of eight tables every plan works on, and its file sources and sinks."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from holdfast.sources.schema import SCHEMAS

# Fixed value: the observation cutoff the published figures were computed at.
DEFAULT_AS_OF = dt.date(2025, 9, 1)


class Tables:
    """Named, lazily opened tables plus the observation date.

    A source is a DataFrame or a zero-argument function returning one; a query
    opens only the tables it touches.
    """

    def __init__(
        self,
        sources: Mapping[str, DataFrame | Callable[[], DataFrame]],
        as_of: dt.date = DEFAULT_AS_OF,
    ):
        self._sources = dict(sources)
        self.as_of = as_of
        self._made: dict[str, object] = {}

    def once(self, key: str, make: Callable[[], object]):
        """What ``make`` returned the first time: a split or a fit that every plan on this bundle shares.

        It lives and ends with the bundle; tables read again are another bundle."""
        if key not in self._made:
            self._made[key] = make()
        return self._made[key]

    def given(self, **made) -> Tables:
        """The same tables with a split or fit made elsewhere."""
        other = Tables(self._sources, self.as_of)
        other._made = {**self._made, **made}
        return other

    def __getitem__(self, name: str) -> DataFrame:
        source = self._sources[name]
        if callable(source) and not isinstance(source, DataFrame):
            source = self._sources[name] = source()
        return source

    def __contains__(self, name: str) -> bool:
        return name in self._sources

    def replace(self, **frames: DataFrame) -> Tables:
        return Tables({**self._sources, **frames}, self.as_of)

    @cached_property
    def customers(self) -> DataFrame:
        return self["customers"]

    @cached_property
    def plans(self) -> DataFrame:
        return self["plans"]

    @cached_property
    def subscriptions(self) -> DataFrame:
        return self["subscriptions"]

    @cached_property
    def transactions(self) -> DataFrame:
        return self["transactions"]

    @cached_property
    def activity(self) -> DataFrame:
        return self["customer_activity"]

    @cached_property
    def tickets(self) -> DataFrame:
        return self["support_tickets"]

    @cached_property
    def campaigns(self) -> DataFrame:
        return self["marketing_campaigns"]

    @cached_property
    def interactions(self) -> DataFrame:
        return self["customer_campaign_interactions"]


#: holds a CSV record that has more or fewer values than the header
BROKEN = "_broken_record"
_CSV = {"header": True, "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN}


def read_tables(
    spark: SparkSession, folder: str, fmt: str = "csv", as_of: dt.date = DEFAULT_AS_OF, ingest_order: bool = False,
    mixed_headers: bool = False, multiline: bool = False,
) -> Tables:
    """Open ``folder/<table>`` (parquet) or ``folder/<table>.csv`` with the declared schema, never inferring types.

    CSV columns are found by the names in the header, in any order; further columns are passed over and a missing one is an
    error. All files of a table must have one header, else the read fails, unless ``mixed_headers`` matches file by file. A
    record with more or fewer values than its header is left out; ``broken_records`` counts these. ``multiline`` allows line
    breaks inside quotes, at the price of reading each file in one task.

    ``ingest_order`` adds the position in the files as ``ingest_ord`` to customers and transactions, so that
    "keep the first occurrence" means what it means for a file. Whole numbers in CSV may be written as ``34.0``, as they
    are once a column had a missing value; ``unreadable`` counts what no type can read.
    """

    def opener(name: str) -> Callable[[], DataFrame]:
        def load() -> DataFrame:
            ordered = ingest_order and name in ("customers", "transactions")
            if fmt == "csv":
                df = csv_records(spark, folder, name, mixed_headers, multiline, ordered).filter(F.col(BROKEN).isNull()).drop(BROKEN)
                return df.withColumns({f.name: typed(f) for f in SCHEMAS[name]})
            df = spark.read.schema(SCHEMAS[name]).format(fmt).load(f"{folder}/{name}")
            return with_ingest_order(df) if ordered else df

        return load

    return Tables({name: opener(name) for name in SCHEMAS}, as_of)


def csv_records(
    spark: SparkSession, folder: str, name: str, mixed_headers: bool = False, multiline: bool = False, ingest_order: bool = False,
) -> DataFrame:
    """Every record of a table's CSV files: its declared columns as text, by header name, and ``BROKEN``."""
    path = f"{folder}/{name}.csv"
    groups: dict[tuple[str, ...], list[str]] = {}
    for part in _csv_files(spark, path) if mixed_headers else [path]:
        groups.setdefault(tuple(_header(spark, part)), []).append(part)
    return reduce(DataFrame.unionByName, [_by_header(spark, name, header, paths, multiline, ingest_order) for header, paths in groups.items()])


def _csv_files(spark: SparkSession, path: str) -> list[str]:
    """The files of a table, from its folder's listing; no contents are read."""
    return sorted(r["path"] for r in spark.read.format("binaryFile").load(path).select("path").collect())


def _header(spark: SparkSession, path: str) -> list[str]:
    return spark.read.options(**_CSV).csv(path).columns


def _by_header(spark: SparkSession, name: str, header: tuple[str, ...], paths: list[str], multiline: bool, ingest_order: bool) -> DataFrame:
    plain = [c.removeprefix("\ufeff").strip().lower() for c in header]
    missing = [f.name for f in SCHEMAS[name] if f.name not in plain]
    if missing:
        raise ValueError(f"{name}: no column {', '.join(missing)} in the header of {paths[0]}")
    text = T.StructType([T.StructField(c, T.StringType()) for c in [*header, BROKEN]])
    # enforceSchema: a file whose header differs fails instead of being read by position; columnPruning: a record is compared
    # with the whole header whatever columns a plan needs
    df = spark.read.schema(text).options(**_CSV, enforceSchema=False, columnPruning=False, multiLine=multiline).csv(paths)
    columns = [F.col("`" + header[plain.index(f.name)].replace("`", "``") + "`").alias(f.name) for f in SCHEMAS[name]]
    # Spark refuses plans that need the broken record alone, as a count of the good ones does: it comes with another column
    broken = F.when(F.coalesce(F.octet_length(F.col("`" + header[0].replace("`", "``") + "`")), F.lit(0)) >= 0, F.col(BROKEN))
    return df.select(*[_position()] * ingest_order, *columns, broken.alias(BROKEN))


def broken_records(spark: SparkSession, folder: str, mixed_headers: bool = False, multiline: bool = False) -> DataFrame:
    """(table_name, records, broken, example): how many records of each table's CSV files have more or fewer values than their
    header and are therefore in no table; one pass over each file."""
    def one(name: str) -> DataFrame:
        return csv_records(spark, folder, name, mixed_headers, multiline).agg(
            F.lit(name).alias("table_name"), F.count("*").alias("records"), F.count(BROKEN).alias("broken"), F.min(BROKEN).alias("example"))

    return reduce(DataFrame.unionByName, [one(name) for name in SCHEMAS])


def typed(field: T.StructField) -> Column:
    """A CSV value in its declared type; missing where it cannot be read."""
    text = F.trim(F.col(field.name))
    if isinstance(field.dataType, T.StringType):
        return F.col(field.name)
    if isinstance(field.dataType, T.DateType):
        # a time of day is allowed behind the date
        return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}([ T].*)?$"), F.substring(text, 1, 10).try_cast("date"))
    if isinstance(field.dataType, (T.IntegerType, T.LongType)):
        number = text.try_cast("decimal(38,10)")
        # half a unit is not a whole number that was written as a decimal
        return F.when(number == F.floor(number), number.try_cast(field.dataType))
    return text.try_cast(field.dataType)


def unreadable(spark: SparkSession, folder: str, mixed_headers: bool = False, multiline: bool = False) -> DataFrame:
    """(table_name, column_name, unreadable, example): per column of the CSV files the values that are there but cannot be
    read in the declared type; one pass over each file. Columns without any, and broken records, are left out."""
    def one(name: str) -> DataFrame:
        raw = csv_records(spark, folder, name, mixed_headers, multiline).filter(F.col(BROKEN).isNull())
        lost = {f.name: F.col(f.name).isNotNull() & (F.trim(f.name) != "") & typed(f).isNull() for f in SCHEMAS[name]}
        cells = raw.agg(*[
            F.struct(F.lit(name).alias("table_name"), F.lit(c).alias("column_name"), F.count_if(bad).alias("unreadable"),
                     F.min(F.when(bad, F.col(c))).alias("example")).alias(c)
            for c, bad in lost.items()
        ])
        return cells.select(F.inline(F.array(*[F.col(c) for c in lost])))

    return reduce(DataFrame.unionByName, [one(name) for name in SCHEMAS]).where("unreadable > 0")


def with_ingest_order(df: DataFrame) -> DataFrame:
    """Add the file, the offset of the split and the row position inside it, which sort in file order."""
    return df.select(_position(), *df.columns)


def _position() -> Column:
    return F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("offset"),
        F.monotonically_increasing_id().alias("row"),
    ).alias("ingest_ord")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Overwrite ``path``; every task writes its own part file."""
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"').option("dateFormat", "yyyy-MM-dd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


CUSTOMER_KEY = "customer_id"


def write_bucketed(tables: Tables, path: str, prefix: str, buckets: int = 64) -> list[str]:
    """Save the tables for repeated use as catalogue tables ``<prefix><table>`` under ``path``. Those that refer to customers are
    bucketed and sorted by customer_id, so that reports at customer grain over ``open_bucketed`` aggregate and join them without
    a shuffle. Tables of the same names are replaced. Choose ``buckets`` so that one holds what a task can sort: a customer's
    rows are in one bucket."""
    names = []
    for name in SCHEMAS:
        df = tables[name]
        df = df.select(*[c for c in SCHEMAS[name].names if c in df.columns])
        writer = df.write
        if CUSTOMER_KEY in df.columns:
            # dealt like the buckets: a task writes one file of its own bucket
            writer = df.repartition(buckets, CUSTOMER_KEY).write.bucketBy(buckets, CUSTOMER_KEY).sortBy(CUSTOMER_KEY)
        writer.mode("overwrite").format("parquet").option("path", f"{path.rstrip('/')}/{name}").saveAsTable(prefix + name)
        names.append(prefix + name)
    return names


def open_bucketed(spark: SparkSession, prefix: str, as_of: dt.date = DEFAULT_AS_OF) -> Tables:
    """The tables that ``write_bucketed`` has saved."""
    return Tables({name: (lambda name=name: spark.table(prefix + name)) for name in SCHEMAS}, as_of)


def register_views(tables: Tables, prefix: str = "") -> list[str]:
    """Expose the tables and the customer view to ``spark.sql``."""
    from holdfast.plans.customer_view import customer_360

    names = []
    for name in SCHEMAS:
        tables[name].createOrReplaceTempView(prefix + name)
        names.append(prefix + name)
    customer_360(tables).createOrReplaceTempView(prefix + "customer_360")
    return names + [prefix + "customer_360"]
