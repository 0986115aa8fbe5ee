"""Words, stable hashes and Arrow plumbing shared by the operators of this package."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from motionlake.session import settle

#: Words of the contract: runs without ASCII white space.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORD_SQL = r"[^\x20\x09-\x0D]++"

#: Texts are turned into Python strings so many rows at a time.
SLICE = 256


def utf8(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def ascii_lower(text: str) -> str:
    """A-Z only; other letters stay."""
    return utf8(text).lower().decode("utf-8", "surrogatepass")


class WordHashes(dict):
    """64-bit hash of each word, remembered up to a bounded number of words."""

    LIMIT = 200_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(utf8(word))
        return value

    def array(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def n_words(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_SQL)), F.lit(0)).cast("long")


def unit_interval(seed: str, key: Column) -> Column:
    """Uniform number in [0, 1) drawn by hash of the key as text (null: empty text); 52 bits."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def by_text(work: Callable[..., Iterator[tuple] | tuple], out: StructType, text: str = "text"):
    """Arrow function for ``mapInArrow``: calls ``work(text, *other columns)`` on each row.

    ``work`` gets the whole text or None and yields output rows.  Rows go through in slices, so memory is bounded by the
    Arrow batch that Spark hands over plus the longest text's results.
    """
    import pyspark.sql.pandas.types as arrow_types

    schema = arrow_types.to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = [n for n in batch.schema.names if n != text]
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                others = [part.column(part.schema.get_field_index(n)).to_pylist() for n in rest]
                texts = part.column(part.schema.get_field_index(text)).to_pylist()
                rows = [row for record in zip(texts, *others, strict=True) for row in work(*record)]
                if rows:
                    columns = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
                    )

    return run


def appending(work: Callable[..., tuple], takes: list[str], adds: StructType):
    """Arrow function for ``mapInArrow``: calls ``work(*values of takes)`` on each row and appends what it returns.

    The other columns pass through untouched.  A column of ``adds`` that is there already is replaced.
    """
    import pyspark.sql.pandas.types as arrow_types

    schema = arrow_types.to_arrow_schema(adds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {n: i for i, n in enumerate(batch.schema.names)}
            kept = [n for n in at if n not in schema.names]
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                rows = [work(*record) for record in zip(*[part.column(at[n]).to_pylist() for n in takes], strict=True)]
                new = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(at[n]) for n in kept] + new, names=kept + schema.names)

    return run


def appended(df: DataFrame, adds: StructType) -> StructType:
    """Schema of the rows that ``appending`` makes of ``df``."""
    return StructType([f for f in df.schema if f.name not in adds.names] + list(adds))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores in front where ``df`` has such a column (whatever its case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def field(df: DataFrame, name: str, alias: str):
    """One column of ``df`` under the name the operator works with."""
    return df[f"`{name}`"].alias(alias)


def id_type(df: DataFrame, name: str):
    return df.schema[name].dataType


def compact(df: DataFrame, rows: int, per_task: int = 250_000) -> DataFrame:
    """``df`` of about ``rows`` small rows in tasks of ``per_task``, but one for each core at least.

    A shuffle writes files for each of its tasks, so steps over few rows in many partitions would fill disks with almost
    empty files.  Rows are not moved.
    """
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // per_task)))


def counted(df: DataFrame, **sums: Column) -> tuple[DataFrame, dict]:
    """``df`` written to the shared folder, with its row count ``n`` and other aggregates, all from the job that writes."""
    seen = Observation()
    df = settle(df.observe(seen, F.count(F.lit(1)).alias("n"), *[c.alias(name) for name, c in sums.items()]))
    return df, seen.get


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read in tasks that its row count asks for."""
    df, seen = counted(df)
    return compact(df, seen["n"])


def delete_path(spark, path: str) -> None:
    """Remove a folder that this package wrote in the shared folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
