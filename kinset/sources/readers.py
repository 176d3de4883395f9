"""Readers: annotated tables, grouped text, FASTA."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinset.functions.records import record_fields, strip_quotes, to_int
from kinset.operators.groups import with_ordinal

# Column names of annotated tables.
ANNOTATED = ("Index", "SEQUENCE_ID", "V_CALL", "J_CALL", "JUNCTION_LENGTH", "JUNCTION")


def read_annotated(
    spark: SparkSession, path: str, columns: dict[str, str] | None = None, typed: bool = True
) -> DataFrame:
    """Header TSV of annotated sequences.

    ``columns`` maps file names to the standard ones, such as ``{"ID":
    "SEQUENCE_ID"}``. Nothing is inferred; ``typed`` makes Index a long and
    JUNCTION_LENGTH an int (null where the text is no number), otherwise all
    columns stay text.
    """
    names = {new: old for old, new in (columns or {}).items()}
    table = spark.read.csv(path, sep="\t", header=True)
    table = table.select(*[F.col(names.get(c, c)).alias(c) for c in ANNOTATED])
    if typed:
        table = table.withColumn("Index", F.col("Index").try_cast("bigint"))
        table = table.withColumn("JUNCTION_LENGTH", F.col("JUNCTION_LENGTH").try_cast("int"))
    return table


def as_sequences(annotated: DataFrame) -> DataFrame:
    """Annotated table to group columns, id, label and seq."""
    return annotated.select(
        "V_CALL", "J_CALL", "JUNCTION_LENGTH",
        F.col("Index").cast("bigint").alias("id"),
        F.col("SEQUENCE_ID").alias("label"),
        F.col("JUNCTION").alias("seq"),
    )


def split_rejects(df: DataFrame, seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    """Rows with a sequence (and, where there is one, an id), and the others."""
    good = F.col(seq).isNotNull() & (F.length(seq) > 0)
    for key in ("id", "Index", "gid"):
        if key in df.columns:
            good = good & F.col(key).isNotNull()
    return df.where(good), df.where(~good)


def parse_grouped(lines: DataFrame, header: str | None = None, on_error: str = "fail") -> DataFrame:
    """Column ``value`` with lines ``gid <tab> "index,label,sequence"`` to records.

    Quotes are removed, not interpreted. Lines equal to ``header`` are dropped
    wherever they occur. A short line or a number out of range fails, or with
    ``on_error='reject'`` gives nulls, for ``split_rejects`` to set apart.
    """
    if header is not None:
        lines = lines.where(~F.col("value").eqNullSafe(F.lit(header)))
    parts = F.split(strip_quotes(F.col("value")), "\t")
    gid = to_int(F.try_element_at(parts, F.lit(1)), on_error, "int")
    fields = record_fields(F.try_element_at(parts, F.lit(2)), on_error)
    return lines.select(gid.alias("gid"), fields.alias("_r")).select("gid", "_r.id", "_r.label", "_r.seq")


def read_grouped(
    spark: SparkSession, path: str, p: int | None = None, on_error: str = "fail"
) -> DataFrame:
    """Text files of ``parse_grouped`` lines under a header line.

    The header is the first line of the first file. ``p`` is the least number of
    partitions, as far as the files' bytes can be cut.
    """
    lines = spark.read.text(path)
    # Spark takes large files first, so the first row is not that of the first file.
    place = F.struct(
        "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row"), "value"
    )
    first = lines.select(place.alias("_line")).agg(F.min("_line")["value"]).first()[0]
    if p is not None:
        lines = lines.repartition(p)
    return parse_grouped(lines.where("value <> ''"), first, on_error)


def parse_fasta(
    chunks: DataFrame, order: list[str], keep_marker: bool = False, odd_tail: str = "reject"
) -> DataFrame:
    """Column ``value`` with one FASTA record each (a leading ``>`` may be there or not)
    to records with ids counted from 0 in ``order``.

    Wrapped sequence lines are joined. A label without a sequence gets a null
    sequence, or with ``odd_tail='repeat'`` its own label line as the sequence.
    """
    if odd_tail not in ("reject", "repeat"):
        raise ValueError(f"odd_tail must be 'reject' or 'repeat', not {odd_tail!r}")
    chunks = chunks.select(*order, F.regexp_replace("value", r"^>|\r", "").alias("_text"))
    chunks = chunks.where(F.trim("_text") != "")
    parts = F.split("_text", "\n", 2)
    body = F.regexp_replace(F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")), r"\s", "")
    label = F.element_at(parts, 1)
    marked = F.concat(F.lit(">"), label)
    empty = marked if odd_tail == "repeat" else F.lit(None).cast("string")
    records = chunks.select(
        *order,
        (marked if keep_marker else label).alias("label"),
        F.when(body == "", empty).otherwise(body).alias("seq"),
    )
    return with_ordinal(records, order, (), "id").select("id", "label", "seq")


def read_fasta(
    spark: SparkSession, path: str, keep_marker: bool = False, odd_tail: str = "reject"
) -> DataFrame:
    """FASTA files; a record starts at a line beginning with ``>``. See ``parse_fasta``."""
    chunks = spark.read.option("lineSep", "\n>").text(path).select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
    )
    return parse_fasta(chunks, ["_file", "_block", "_row"], keep_marker, odd_tail)
