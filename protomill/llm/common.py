"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of one Arrow batch are handed to Python code in slices of about so many bytes.
SLICE_BYTES = 4 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, a Parquet file or folder named after it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    The cluster names it in ``spark.checkpoint.dir``.  Only where that is unset (a local session,
    as in tests) a temporary folder is made and set; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        found = context.getCheckpointDir()
        if not found:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir is not set: the driver and the executors share no folder")
            found = tempfile.mkdtemp(prefix="protomill-")
            context.setCheckpointDir(found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    Cuts the lineage: a lost executor costs the tasks that read the table, not those that made it,
    and two consumers don't compute ``df`` twice.
    """
    path = f"{shared_dir(df.sparkSession)}/protomill-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``stored`` that nothing reads any more: what was made of them is stored itself."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.stored_at)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


#: What a Python worker remembers, by operator.
_MEMORY: dict[str, dict] = {}


def memory(operator: str) -> dict:
    """What this Python worker remembers for an operator; what it holds for others is dropped.

    Workers outlive the stages of a pipeline, so their memory would otherwise add up.
    """
    for other in [x for x in _MEMORY if x != operator]:
        del _MEMORY[other]
    return _MEMORY.setdefault(operator, {})


#: A key with more than this part of all rows is hot; so there are never more hot keys than its inverse.
HOT_SHARE = 1 / 10_000


def hot_split_join(left: DataFrame, right: DataFrame, on: list[str], count: str, rows: int) -> DataFrame:
    """Inner join in which hot keys fill no task.

    ``right`` has one row for each key and is stored; its column ``count`` says in how many of the ``rows`` of ``left`` the key stands.
    Rows of hot keys (10,000 keys at most, whatever the table) meet a broadcast and are not shuffled.
    """
    edge = max(rows * HOT_SHARE, 100)
    hot = right.where(F.col(count) > edge)
    some = left.join(F.broadcast(hot), on)
    rest = left.join(F.broadcast(hot.select(*on)), on, "left_anti").join(right.where(F.col(count) <= edge), on)
    return some.unionByName(rest)


def document_keys(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Adds the columns ``__d`` and ``__k``, which together determine the text.

    ``__d`` is the id (0 for null) and ``__k`` a 64-bit hash of the text, so that two rows share the key
    only if they have the same id and (but for a collision under one id) the same text.  Ids may
    repeat or be null, and copies of one hot text still have different keys.
    """
    return docs.withColumns(
        {
            "__d": F.coalesce(F.col(id_col).cast("long"), F.lit(0).cast("long")),
            "__k": F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))),
        }
    )


def slices(batches: Iterator[pa.RecordBatch], text_at: int, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that the texts of a slice stay near ``size`` bytes (one row at least)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        limit = max(1, batch.num_rows * size // max(1, batch.column(text_at).nbytes))
        for at in range(0, batch.num_rows, limit):
            yield batch.slice(at, limit)


def map_texts(
    df: DataFrame, keep: list[str], text_col: str, schema: str, make: Callable[[], Callable[[list[str]], list[list]]]
) -> DataFrame:
    """Columns ``keep`` of every row, and columns computed from its whole text (null: empty).

    ``make`` runs once in each task and returns a function from a list of texts to one list of values
    for each new column.  ``schema`` is the DDL of the new columns; a kept column with the name of one is replaced.
    """
    new = {name for name, _ in new_fields(schema)}
    keep = [c for c in keep if c not in new]
    # a text that is kept crosses to Python once
    at = keep.index(text_col) if text_col in keep else len(keep)
    chosen = df.select(*keep, *([] if text_col in keep else [F.col(text_col).alias("__text")]))
    run = _mapper(at, keep, new_fields(schema), make)
    return chosen.mapInArrow(run, with_fields(chosen, len(keep), schema))


def with_fields(df: DataFrame, kept: int, schema: str) -> T.StructType:
    """The first ``kept`` columns of ``df`` and those of a DDL."""
    return T.StructType([*df.schema.fields[:kept], *T.StructType.fromDDL(schema).fields])


def new_fields(schema: str) -> list[tuple[str, pa.DataType]]:
    """Names and Arrow types of the columns of a DDL."""
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "array<string>": pa.list_(pa.string())}
    return [(f.name, kinds[f.dataType.simpleString()]) for f in T.StructType.fromDDL(schema).fields]


def _mapper(text_at: int, names: list[str], fields: list[tuple[str, pa.DataType]], make: Callable) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for part in slices(batches, text_at):
            texts = [x or "" for x in part.column(text_at).to_pylist()]
            columns = [part.column(i) for i in range(len(names))]
            columns += [pa.array(values, type=kind) for values, (_, kind) in zip(work(texts), fields, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *[name for name, _ in fields]])

    return run


def numbered(df: DataFrame, named: list[str]) -> tuple[DataFrame, list[str]]:
    """``df`` with its columns renamed to c0, c1, ... but for those ``named``, and the new names in order.

    Lets an operator add columns of its own to a table whose other columns may have any names.
    """
    new = [c if c in named else f"__c{i}" for i, c in enumerate(df.columns)]
    return df.toDF(*new), new
