"""Helpers that the text operators share: tables, folds, words, UDFs over texts."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from contextvars import ContextVar
from functools import reduce
from operator import and_
from typing import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import storage

__all__ = ["ascii_lower", "bucket", "fields", "free_name", "passing", "span_text", "stage", "table", "text_udf", "without", "words"]

#: A-Z to a-z only; other letters keep their case.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Whatever is not part of a word of the text contracts: ASCII other than digits and lower-case letters.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of an Arrow batch while a table is staged.
BATCH_BYTES = "8m"
#: Paths of tables that are deleted at the end of each `passing` block that is open.
_OPEN: ContextVar[tuple[list[str], ...]] = ContextVar("open", default=())


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables that are staged within are deleted at the end, but for those to be kept."""
    made: list[str] = []
    token = _OPEN.set((*_OPEN.get(), made))
    try:
        yield
    finally:
        _OPEN.reset(token)
        for path in made:
            storage.delete_tree(spark, path)


def stage(spark: SparkSession, df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """df as a table in the shared folder.  Rows may be long, so Arrow batches are small while it is written; then the session has its
    own setting again.  keep: beyond the innermost `passing` block."""
    path = storage.scratch(spark, name)
    blocks = _OPEN.get()[: -1 if keep else None]
    if blocks:
        blocks[-1].append(path)
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = spark.conf.get(setting)
    spark.conf.set(setting, BATCH_BYTES)
    try:
        return storage.write_and_read(spark, df, path)
    finally:
        spark.conf.set(setting, own)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone.  Pure ASCII texts take the fast path; it gives the same."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )


def words(text: Column) -> Column:
    """The words of a text under the word rule above, as an array; null or wordless: empty."""
    parts = F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD)
    return F.filter(parts, lambda w: w != "")


def bucket(col: Column, of: int) -> Column:
    """crc32 of an id's decimal text, modulo `of`: the folds of the labelled operators."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % of


def text_udf(schema: T.StructType, make: Callable[[], Callable[[str], tuple]]) -> Callable[[Column], Column]:
    """An Arrow UDF over one text column.  `make` runs once for each task and returns a function from a
    text (null comes as "") to one tuple of the schema's fields."""
    arrow = [to_arrow(f.dataType) for f in schema.fields]
    names = [f.name for f in schema.fields]

    def run(batches):
        one = make()
        for texts in batches:
            rows = [one(t or "") for t in (x.as_py() for x in texts)]
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            yield pa.StructArray.from_arrays(
                [pa.array(list(c), a) for c, a in zip(cols, arrow, strict=True)], names=names
            )

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, schema).asNondeterministic()


def to_arrow(kind: T.DataType) -> pa.DataType:
    return to_arrow_type(kind)


def fields(spec: str) -> T.StructType:
    """'a long, b string' as a StructType, without a session."""
    kinds = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "double": T.DoubleType(),
             "boolean": T.BooleanType(), "binary": T.BinaryType(), "array<long>": T.ArrayType(T.LongType()),
             "array<int>": T.ArrayType(T.IntegerType()), "array<string>": T.ArrayType(T.StringType()), "array<double>": T.ArrayType(T.DoubleType())}
    return T.StructType([T.StructField(*(lambda p: (p[0], kinds[p[1]]))(x.split())) for x in spec.split(",")])


def span_text(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


#: Ids up to which a list of rows to drop is broadcast, as counted; beyond it the join shuffles.
BROADCAST_IDS = 100_000


def free_name(df: DataFrame, name: str) -> str:
    """name, with marks before it until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def without(docs: DataFrame, gone: DataFrame, *by: str, keep: bool = False) -> DataFrame:
    """The rows of docs whose columns `by` are not among the rows of gone, which has as many columns; nulls equal nulls.  keep:
    those that are."""
    names = [free_name(docs, f"gone{i}") for i in range(len(by))]
    gone = gone.toDF(*names).distinct()
    few = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    same = reduce(and_, (docs[f"`{c}`"].eqNullSafe(gone[n]) for c, n in zip(by, names, strict=True)))
    return docs.join(F.broadcast(gone) if few else gone, same, "left_semi" if keep else "left_anti")
