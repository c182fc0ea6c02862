"""Records of JSON array files of any size, found bracket by bracket, so that a bad one costs itself.

A file is read in the splits Spark makes of it, cut at every `}`. Whether a piece begins inside a
string, how deep it lies and which record it belongs to follow from sums over the pieces before it.
They are added up split by split, and a row per split carries them on; no task reads a whole file.

Defined results: an element that is no JSON is a record of its own text, whatever stands around it.
Where a string is left open, the record ends at the next `}` that `, {"name":` follows, which no
valid JSON has inside a string. A record that lacks a bracket takes the rest up to such a place. A
record of more than `RECORD_BYTES` comes in pieces, which are no JSON. A file cut off in the middle
keeps its whole records, the rest is one more. A file that is no array is one record; an empty one,
or an empty array, has none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wiregrid.session import materialize

#: The longest record that is kept in one piece.
RECORD_BYTES = 16 << 20

_PLACE = ["_file", "_split", "_chunk"]
_SYNC = r'^\s*,\s*\{\s*"[A-Za-z_]\w*"\s*:'


def _depth(text: Column) -> Column:
    """Brackets opened less those closed outside of strings; `text` begins outside, has no escapes."""
    bare = F.regexp_replace(text, r'"[^"]*("|\z)', "")
    opened = F.length(bare) - F.length(F.translate(bare, "{[", ""))
    return opened - (F.length(bare) - F.length(F.translate(bare, "}]", "")))


def _since(rows: DataFrame, **sums: tuple[Column, Column]) -> DataFrame:
    """`rows` with, for every name, (add, reset): `add` summed over the rows before in the file.

    The sum begins anew with a row where `reset` holds, which is the first it counts again. The sums
    of a split are its own; a row per split carries them to the splits after it.
    """
    own = Window.partitionBy("_file", "_split").orderBy("_chunk")
    upto_here = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = own.rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("_file").orderBy("_split")
    running = across.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = rows
    for name, (add, reset) in sums.items():
        summed = (
            summed.withColumn(f"_sum_{name}", F.sum(add.cast("long")).over(upto_here))
            .withColumn(f"_upto_{name}", F.col(f"_sum_{name}") - add)
            .withColumn(f"_mark_{name}", F.when(reset, F.col(f"_upto_{name}")))
            .withColumn(f"_base_{name}", F.last(f"_mark_{name}", True).over(earlier))
        )
    stored, _ = materialize(summed, "record-sums")
    ends = stored.groupBy("_file", "_split").agg(
        *[F.max_by(f"_sum_{name}", "_chunk").alias(f"_sum_{name}") for name in sums],
        *[F.max(f"_mark_{name}").alias(f"_mark_{name}") for name in sums],
    )
    for name in sums:
        tail, fresh = F.col(f"_tail_{name}"), F.col(f"_mark_{name}").isNotNull()
        ends = (
            ends.withColumn(
                f"_tail_{name}",
                F.col(f"_sum_{name}") - F.coalesce(F.col(f"_mark_{name}"), F.lit(0)),
            )
            .withColumn(f"_all_{name}", F.sum(tail).over(running))
            .withColumn(
                f"_from_{name}",
                F.last(F.when(fresh, F.col(f"_all_{name}") - tail), True).over(running),
            )
        )
    starts = ends.select(
        "_file", "_split",
        *[
            F.lag(F.col(f"_all_{name}") - F.coalesce(f"_from_{name}", F.lit(0)), 1, 0)
            .over(across).alias(f"_start_{name}")
            for name in sums
        ],
    )
    told = [
        (F.col(f"_upto_{name}") - F.coalesce(f"_base_{name}", -F.col(f"_start_{name}"))).alias(name)
        for name in sums
    ]
    return stored.join(starts, ["_file", "_split"]).select(*rows.columns, *told)


def _chunks(files: DataFrame, name: Column) -> DataFrame:
    """Pieces of the files with what their characters say, whatever stands before them."""
    plain = F.regexp_replace("value", r"(?s)\\.", "")
    pieces = files.select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_size").alias("_size"),
        F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_chunk"),
        name.alias("_name"),
        "value",
        plain.alias("_plain"),
    )
    pieces, _ = materialize(
        pieces.select(
            *_PLACE, "_size", "_name", "value",
            F.octet_length("value").alias("_bytes"),
            (F.length("_plain") - F.length(F.translate("_plain", '"', ""))).alias("_quotes"),
            F.col("value").rlike(_SYNC).alias("_sync"),
            _depth(F.col("_plain")).alias("_out"),
            _depth(F.concat(F.lit('"'), F.col("_plain"))).alias("_in"),
        ),
        "record-chunks",
    )
    return pieces


def _numbered(pieces: DataFrame) -> DataFrame:
    """The place of every piece, its record in the file, its part of it, and whether `}` follows."""
    # What a file ends with has no `}` after it, unless the file is longer by just that byte.
    last = pieces.groupBy("_file").agg(
        F.max(F.struct("_split", "_chunk")).alias("_last"),
        (F.sum(F.col("_bytes") + 1) > F.max("_size")).alias("_bare"),
    )
    is_last = F.struct("_split", "_chunk") == F.col("_last")
    narrow = (
        pieces.drop("value", "_name", "_size")
        .join(last, "_file")
        .withColumn("_final", is_last)
        .withColumn("_followed", ~(is_last & F.col("_bare")))
        .drop("_last", "_bare")
    )
    # A string still open at a sync place spoils the record before; the place is outside of it.
    known = _since(narrow, _open=(F.col("_quotes"), F.col("_sync")))
    inside = (F.col("_open") % 2 == 1) & ~F.col("_sync")
    known = known.withColumn("_spoiled", F.col("_sync") & (F.col("_open") % 2 == 1)).withColumn(
        "_closed",
        F.col("_followed") & ((inside.cast("int") + F.col("_quotes")) % 2 == 0),
    ).withColumn(
        "_delta", F.when(inside, F.col("_in")).otherwise(F.col("_out")) - F.col("_closed").cast("int")
    )
    spoiled = F.col("_spoiled").cast("int")
    known = _since(known, _deep=(F.col("_delta") + spoiled, F.col("_spoiled")))
    deep = F.when(F.col("_spoiled"), F.lit(1)).otherwise(F.col("_deep")) + F.col("_delta")
    known = known.withColumn("_end", F.col("_closed") & (deep <= 1))
    known = _since(
        known,
        _record=(F.col("_end").cast("int") + spoiled, F.lit(False)),
        _held=(
            F.when(F.col("_end"), F.lit(0)).otherwise(F.col("_bytes") + 1),
            F.col("_end") | F.col("_spoiled"),
        ),
    )
    held = F.when(F.col("_spoiled"), F.lit(0)).otherwise(F.col("_held"))
    return known.select(
        *_PLACE, "_final", "_followed",
        (F.col("_record") + spoiled).alias("_record"),
        F.floor(held / RECORD_BYTES).alias("_part"),
    )


def read_records(
    spark: SparkSession, path: str, name: Column | None = None, **options: str
) -> DataFrame:
    """(name, place, raw_json) of every record of the JSON array files under `path`.

    `place` counts the elements of a file from 0, `name` is the file's name or a column given.
    """
    files = spark.read.options(**options).text(path, lineSep="}")
    pieces = _chunks(files, F.col("_metadata.file_name") if name is None else name)
    parts = (
        _numbered(pieces)
        .join(pieces.select(*_PLACE, "_name", "value"), _PLACE)
        .withColumn("_text", F.when(F.col("_followed"), F.concat("value", F.lit("}"))).otherwise(F.col("value")))
        .groupBy("_file", "_record", "_part")
        .agg(
            F.min(F.struct("_split", "_chunk")).alias("_first"),
            F.max("_final").alias("_final"),
            F.any_value("_name").alias("name"),
            F.sort_array(F.collect_list(F.struct("_split", "_chunk", "_text"))).alias("_texts"),
        )
    )
    begun = (F.col("_record") == 0) & (F.col("_part") == 0)
    body = F.array_join(F.col("_texts._text"), "")
    body = F.when(begun, F.regexp_replace(body, r"^\s*\[", "")).otherwise(body)
    body = F.when(F.col("_final"), F.regexp_replace(body, r"\]\s*\z", "")).otherwise(body)
    body = F.regexp_replace(body, r"^[\s,]+|\s+\z", "")
    found = parts.select(
        "_file", F.col("_first._split").alias("_split"), F.col("_first._chunk").alias("_chunk"),
        "name", body.alias("_body"),
    ).where("_body <> ''")
    elements = F.from_json(F.concat(F.lit("["), "_body", F.lit("]")), "array<string>")
    found = found.select(
        *_PLACE, "name", F.coalesce(elements, F.array("_body")).alias("_elements")
    )
    placed = _since(found, _before=(F.size("_elements"), F.lit(False)))
    return placed.select("name", "_before", F.posexplode("_elements").alias("_place", "raw_json")).select(
        "name", (F.col("_before") + F.col("_place")).alias("place"), "raw_json"
    )
