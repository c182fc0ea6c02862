"""The landing area of raw batches, partitioned by day and ticker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wiregrid.operators.normalize import feed_order
from wiregrid.schemas import RAW_ARTICLE
from wiregrid.sources.records import read_records

#: Bounds of one batch file.
FILE_ROWS, FILE_BYTES = 4_096, 4 << 20

_MARKER = -1  # batch_pos of the row that stands for "fetched, nothing came"


def write_landing(batch: DataFrame, path: str, attempted: DataFrame | None = None) -> None:
    """Write `batch` (ticker, fetch_date, batch_pos, raw_json), replacing its days and tickers.

    `attempted` lists every (ticker, fetch_date) that was asked for; where
    nothing came, the old batch of that day gives way to an empty one.
    """
    rows = batch.select("ticker", "fetch_date", "batch_pos", "raw_json")
    if attempted is not None:
        markers = attempted.select(
            "ticker",
            "fetch_date",
            F.lit(_MARKER).alias("batch_pos"),
            F.lit(None).cast("string").alias("raw_json"),
        )
        rows = rows.unionByName(markers)
    # The rebalance hint lets AQE merge small and split large day-and-ticker groups.
    (
        rows.hint("rebalance", "fetch_date", "ticker")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("fetch_date", "ticker")
        .parquet(path)
    )


def read_landing(
    spark: SparkSession, path: str, days: tuple[str, str] | None = None, ticker: str | None = None
) -> DataFrame:
    """Landed raw records; `days` (first, last) and `ticker` prune partitions."""
    raw = spark.read.schema(RAW_ARTICLE).parquet(path)
    if days:
        raw = raw.where(F.col("fetch_date").between(*[F.lit(d).cast("date") for d in days]))
    if ticker is not None:
        raw = raw.where(F.col("ticker") == ticker)
    return raw.where(F.col("batch_pos") > _MARKER)


def read_json_batches(
    spark: SparkSession, path: str, name: Column | None = None, **options: str
) -> DataFrame:
    """Raw records of files `{TICKER}_{YYYY-MM-DD}.json`, each a JSON array of records.

    A large batch comes in several files `{TICKER}_{YYYY-MM-DD}.{FIRST}.json`, where FIRST is the
    batch position of the file's first record. Files may be of any size; text that is no record is
    one of its own, which normalising sets aside (see `records`). `name` gives the name of a file
    that is not called so.
    """
    if name is None:
        options["pathGlobFilter"] = "*_*.json"
    found = read_records(spark, path, name, **options)
    return found.select(
        *_named(F.col("name")),
        "place",
        "raw_json",
    ).select(
        "ticker", "fetch_date", (F.col("_first") + F.col("place")).cast("int").alias("batch_pos"),
        "raw_json",
    )


def _named(name: Column) -> list[Column]:
    """Ticker, day and first batch position as the name of a batch file tells them."""
    pattern = r"^(.+)_(\d{4}-\d{2}-\d{2})(?:\.(\d+))?\.json$"
    return [
        F.regexp_extract(name, pattern, 1).alias("ticker"),
        F.regexp_extract(name, pattern, 2).try_cast("date").alias("fetch_date"),
        F.coalesce(F.regexp_extract(name, pattern, 3).try_cast("int"), F.lit(0)).alias("_first"),
    ]


def explode_batches(files: DataFrame, name: Column) -> DataFrame:
    """Records of batch files (`value`); `is_file` tells a file that is no JSON array."""
    opened = files.select(
        *_named(name),
        "value",
        F.from_json("value", "array<string>").alias("_records"),
    )
    return opened.select(
        "ticker",
        "fetch_date",
        "_first",
        F.col("_records").isNull().alias("is_file"),
        F.posexplode(F.coalesce("_records", F.array("value"))).alias("_place", "raw_json"),
    ).select(
        "ticker", "fetch_date", (F.col("_first") + F.col("_place")).alias("batch_pos"), "raw_json",
        "is_file",
    )


def batch_files(raw: DataFrame, day: str) -> DataFrame:
    """The records of each ticker as texts of JSON arrays (`ticker`, `name`, `value`).

    A batch is cut into files of at most `FILE_ROWS` records and `FILE_BYTES` (and the record that
    crosses it), read by `explode_batches`. No file holds records of two neighbourhoods of
    `batch_pos`, so no task and no row ever takes a whole ticker.
    """
    place = F.col("batch_pos")
    near = ["ticker", "_near"]
    order = Window.partitionBy(*near).orderBy("batch_pos", "raw_json")
    before = F.sum(F.octet_length("raw_json").cast("long")).over(
        order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ) - F.octet_length("raw_json")
    cut = (
        raw.withColumn("_near", F.floor(place / FILE_ROWS))
        .withColumn("_file", F.floor(before / FILE_BYTES))
        .withColumn("_row", F.row_number().over(order) - 1)
    )
    records = F.sort_array(F.collect_list(F.struct("_row", "raw_json")))
    files = cut.groupBy(*near, "_file").agg(
        F.min("_row").alias("_first"), records.alias("_records")
    )
    first = (F.col("_near") * FILE_ROWS + F.col("_first")).cast("string")
    return files.select(
        "ticker",
        F.concat("ticker", F.lit(f"_{day}."), first, F.lit(".json")).alias("name"),
        F.concat(
            F.lit("["), F.array_join(F.col("_records.raw_json"), ","), F.lit("]")
        ).alias("value"),
    )


def in_feed_order(raw: DataFrame, watchlist: DataFrame) -> DataFrame:
    """Records with `seq`: by day, watchlist position and batch position.

    A record whose ticker is missing or not watched has none and is not `watched`; normalising
    sets it aside.
    """
    return raw.join(watchlist, "ticker", "left").select(
        "ticker",
        "fetch_date",
        "batch_pos",
        "raw_json",
        feed_order(
            F.col("fetch_date"), F.col("position"), F.col("batch_pos"), tickers=1 << 31
        ).alias("seq"),
        F.col("position").isNotNull().alias("watched"),
    )
