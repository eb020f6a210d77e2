"""Helpers shared by the operators: reading, Arrow maps, cutting lineage."""

from __future__ import annotations

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.checkpoints import cut, shared_folder  # noqa: F401

#: Rows that a function over Arrow batches is given at once.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_map(df: DataFrame, columns: dict[str, Column], make, schema: str, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """Run ``make()``'s function over Arrow batches of the named columns only.

    ``make`` is called once a partition; its function takes a RecordBatch of
    ``batch_rows`` rows at most and returns the output columns in the order of
    ``schema``. The session's own batch size stays as it is.
    """
    target = df.sparkSession.createDataFrame([], schema).schema
    names = target.fieldNames()
    types = {f.name: _arrow_type(f.dataType.simpleString()) for f in target}

    def run(batches):
        step = make()
        for whole in batches:
            for low in range(0, whole.num_rows, batch_rows):
                out = step(whole.slice(low, batch_rows))
                arrays = [x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, types[n]) for n, x in zip(names, out, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return df.select(*[c.alias(n) for n, c in columns.items()]).mapInArrow(run, schema)


def _arrow_type(name: str) -> pa.DataType:
    plain = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
    if name.startswith("array<"):
        return pa.list_(_arrow_type(name[6:-1]))
    return plain[name]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until ``df`` has no such column."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def _plain_files(df: DataFrame) -> bool:
    """Rows of one file source, as they are there or fewer."""
    node = df._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.child()
    return node.nodeName().startswith("LogicalRelation")


def _placed(df: DataFrame, names: list[str]) -> DataFrame | None:
    """With file and place of each row; None where a column of the data hides them."""
    if "_metadata" in {c.lower() for c in df.columns}:
        return None
    try:
        return df.withColumns({names[1]: F.col("_metadata.file_path"), names[2]: F.col("_metadata.row_index")})
    except AnalysisException:
        return None


def numbered(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """``df`` with columns that together tell each row from all others, and their
    names: a hash of the row, and its file and place there. Rows of anything but
    files have no such place and are checkpointed with a number instead."""
    names = fresh(df, "row_hash", "row_file", "row_place")
    plain = [F.col(f"`{f.name}`") for f in df.schema if not any(kind in f.dataType.simpleString() for kind in ("map<", "variant"))]
    kept = _placed(df, names) if _plain_files(df) else None
    if kept is None:
        kept = cut(df.withColumns({names[1]: F.lit(""), names[2]: F.monotonically_increasing_id()}))
    return kept.withColumn(names[0], F.xxhash64(*plain)), names


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with each row's place in ``order``, from 0. Ranges of rows are sorted
    and counted apart; only their counts reach the driver."""
    (at,) = fresh(df, "at")
    sorted_ = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()))
    part = F.shiftright(at, 33)
    counts = sorted(sorted_.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    if not counts:
        return sorted_.withColumn(name, F.col(at)).drop(at)
    before, total = {}, 0
    for p, n in counts:
        before[p], total = total, total + n
    first = F.create_map(*[F.lit(x).cast("long") for pair in before.items() for x in pair])
    return sorted_.withColumn(name, F.element_at(first, part) + F.col(at).bitwiseAND(F.lit((1 << 33) - 1))).drop(at)


def raw_texts(column: pa.Array):
    """The UTF-8 bytes of each text, without building Python strings; null: empty."""
    if column.type != pa.binary():
        column = column.cast(pa.binary())
    for value in column:
        yield value.as_py() or b""


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the documents kept out of learning; a null id: false."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))
