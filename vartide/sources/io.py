"""Readers and writers of returns, forecasts and result tables.

Tables stay partitioned by model and asset, so that a filter on either prunes files; wide files are unpivoted
on the way in and pivoted only at the outer edge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RETURNS_CSV = "date date, log_return double"
#: Forecast files carry one column for each level.
LEVEL_COLUMN = r"^VaR_(0\.\d+)$"


def read_returns_csv(spark: SparkSession, path: str) -> DataFrame:
    """asset, date, r from one CSV file per asset (date, log_return); the file's name is the asset."""
    rows = spark.read.schema(RETURNS_CSV).option("header", True).csv(path)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv", 1)
    return rows.select(F.regexp_replace(name, "%20", " ").alias("asset"), "date", F.col("log_return").alias("r")).dropna(subset=["date", "r"])


def read_forecasts(spark: SparkSession, path: str) -> DataFrame:
    """model, asset, date, alpha, q from parquet under model=/asset=, whose columns may differ between models."""
    wide = spark.read.option("mergeSchema", True).parquet(path)
    levels = {c: float(c[4:]) for c in wide.columns if c.startswith("VaR_0")}
    long = wide.unpivot(["model", "asset", "date"], [f"`{c}`" for c in levels], "level", "q").filter(F.col("q").isNotNull() & ~F.isnan("q"))
    return long.select("model", "asset", F.to_date("date").alias("date"), F.regexp_extract("level", LEVEL_COLUMN, 1).cast("double").alias("alpha"), "q")


def read_routed(spark: SparkSession, folders: dict[str, str]) -> DataFrame:
    """source, model, asset, date, alpha, q of several stores (source: folder), each in the layout of
    `read_forecasts`; a filter on source drops the other folders from the plan."""
    out = None
    for source, folder in folders.items():
        one = read_forecasts(spark, folder).select(F.lit(source).alias("source"), "*")
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no folders given")
    return out


def write_forecasts(paths: DataFrame, path: str) -> None:
    """model, asset, date, alpha, q to parquet under model=/asset=, one column for each level."""
    wide = paths.withColumn("level", F.concat(F.lit("VaR_"), F.col("alpha").cast("string"))).groupBy("model", "asset", "date").pivot("level").agg(F.first("q"))
    wide.repartition("model", "asset").sortWithinPartitions("date").write.mode("overwrite").partitionBy("model", "asset").parquet(path)


def write_new(rows: DataFrame, path: str, keys: tuple[str, ...] = ("model", "asset")) -> int:
    """Append the partitions that path lacks (resuming an interrupted run); returns how many rows it added."""
    spark = rows.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        rows = rows.join(spark.read.parquet(path).select(*keys).distinct(), list(keys), "left_anti")
    before = rows.count()
    rows.write.mode("append").partitionBy(*keys).parquet(path)
    return before


def read_map_json(spark: SparkSession, path: str) -> DataFrame:
    """key, value of one JSON object."""
    one = spark.read.option("multiLine", True).json(path)
    return one.unpivot([], one.columns, "key", "value")


def read_results_csv(spark: SparkSession, path: str, renamed: dict[str, str] | None = None) -> DataFrame:
    return spark.read.option("header", True).option("inferSchema", True).csv(path).withColumnsRenamed(renamed or {})


def read_excel(spark: SparkSession, path: str, date: str = "Date") -> DataFrame:
    """A small workbook, through pandas on the driver (needs a reader such as openpyxl)."""
    import pandas as pd

    book = pd.read_excel(path)
    return spark.createDataFrame(book.assign(**{date: pd.to_datetime(book[date])}).sort_values(date)).withColumn(date, F.to_date(date))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def verified(spark: SparkSession, path: str, sha256: dict[str, str]) -> DataFrame:
    """file, ok: the files under path against their digests."""
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.sha2("content", 256).alias("sha"))
    want = F.create_map(*[F.lit(x) for kv in sha256.items() for x in kv]) if sha256 else F.lit(None).cast("map<string,string>")
    return files.select("file", F.coalesce(F.element_at(want, F.col("file")) == F.col("sha"), F.lit(False)).alias("ok"))


def plausible_pairs(paths: DataFrame, most: float = 1.0) -> DataFrame:
    """Rows of pairs whose mean forecast size is at most `most` (files in other units drop out)."""
    good = paths.groupBy("model", "asset").agg(F.avg(F.abs("q")).alias("_size")).filter(F.col("_size") <= most).select("model", "asset")
    return paths.join(good, ["model", "asset"], "left_semi")


def register_price_source(spark: SparkSession) -> None:
    """The data source `vartide_prices`: CSV files (date, close) under a folder, either <ticker>.csv or <ticker>/<year>.csv, a
    partition each. It stands where a market-data service would be; there is no network here.

    The folder may be any address that Arrow's file systems know (a path, file:, hdfs:, s3:...), as tasks open files through
    them. Filters on asset and date decide which files are opened: other tickers' and other years' are not."""
    from pyspark.sql import datasource

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")

    def file_system(folder: str):
        from pyarrow import fs

        return fs.FileSystem.from_uri(folder) if ":" in folder else (fs.LocalFileSystem(), folder)

    class Prices(datasource.DataSourceReader):
        def __init__(self, options):
            self.folder, self.wanted = options["folder"].rstrip("/"), None
            if options.get("tickers"):
                self.wanted = {t for t in options["tickers"].split(",") if t}
            self.first, self.last = None, None

        def pushFilters(self, filters):
            for f in filters:
                name, value = f.attribute[0], getattr(f, "value", None)
                if name == "asset" and isinstance(f, datasource.EqualTo | datasource.In):
                    these = {value} if isinstance(f, datasource.EqualTo) else set(value)
                    self.wanted = these if self.wanted is None else self.wanted & these
                elif name == "date" and value is not None:
                    if isinstance(f, datasource.EqualTo | datasource.GreaterThan | datasource.GreaterThanOrEqual):
                        self.first = value if self.first is None else max(self.first, value)
                    if isinstance(f, datasource.EqualTo | datasource.LessThan | datasource.LessThanOrEqual):
                        self.last = value if self.last is None else min(self.last, value)
                yield f  # files are coarser than filters: Spark applies them again

        def partitions(self):
            from pyarrow import fs

            store, root = file_system(self.folder)
            files = []
            for info in store.get_file_info(fs.FileSelector(root, recursive=True)):
                ticker, _, year = info.path[len(root) :].strip("/").removesuffix(".csv").partition("/")
                if info.type != fs.FileType.File or not info.path.endswith(".csv") or (self.wanted is not None and ticker not in self.wanted):
                    continue
                if year and ((self.first and int(year) < self.first.year) or (self.last and int(year) > self.last.year)):
                    continue
                files.append((ticker, info.path))
            return [datasource.InputPartition(f) for f in sorted(files)]

        def read(self, partition):
            import csv
            import datetime
            import io

            if partition is None or partition.value is None:  # no file is left
                return
            ticker, path = partition.value
            with file_system(self.folder)[0].open_input_stream(path) as f:
                for row in csv.DictReader(io.TextIOWrapper(f, newline="")):
                    yield ticker, datetime.date.fromisoformat(row["date"]), float(row["close"])

    class PriceSource(datasource.DataSource):
        @classmethod
        def name(cls):
            return "vartide_prices"

        def schema(self):
            return "asset string, date date, p double"

        def reader(self, schema):
            return Prices(self.options)

    spark.dataSource.register(PriceSource)
