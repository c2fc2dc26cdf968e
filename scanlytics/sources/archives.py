"""ZIP archives of CSV logs.

A ZIP entry cannot be split (deflate has no entry points), so the unit of work is an entry; entries are dealt out to
tasks by size. An entry is decompressed and parsed in chunks, never as a whole. Land the rows once (see ``landing``) and run the metrics on the
landed table.
"""

from __future__ import annotations

import io
import itertools
import posixpath
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import csv
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scanlytics.functions import columns as C
from scanlytics.schema import LOG_COLUMNS, NULL_TOKENS, RAW_SCHEMA
from scanlytics.session import scratch_path
from scanlytics.sources.remote import open_file, ship_code

_CHUNK_ROWS = 50_000
#: Entries up to this size are read at once.
_SMALL_BYTES = 1 << 20
#: What readers of CSV take differently: quotes, carriage returns, NUL, byte order marks, lines of white space.
_MARKS = (b'"', b"\r", b"\0", b"\xef\xbb\xbf", b"\n ", b"\n\t", b"\n\n")
#: Rows of small entries that are handed to Spark at once.
_BATCH_ROWS = 10_000
#: Tasks that read archives' directories.
_LISTING_PARTS = 64
#: Packed bytes that one task unpacks, unless an entry has more.
_TASK_BYTES = 32 << 20
#: What opening an entry costs, as bytes.
_ENTRY_BYTES = 64 << 10
_HEADER_TYPE = pa.list_(pa.string())


def csv_entries(archive: zipfile.ZipFile, path: str) -> list[str]:
    """Entries that end in .csv (as written, at any depth); an archive without one is an error."""
    entries = [name for name in archive.namelist() if name.endswith(".csv")]
    if not entries:
        raise ValueError(f"no CSV files in {path}")
    return entries


def _plain_table(data: bytes) -> pa.Table | None:
    """The columns of CSV text without anything that readers take differently; None for any other.

    Arrow reads a small text many times faster than pandas, whose reading is what counts: with quotes, carriage returns,
    a byte order mark, names that are missing or repeat, or rows of other lengths it is left to pandas.
    """
    line, _, rest = data.partition(b"\n")
    names = line.split(b",")
    named = len(names) > 1 and all(n.strip() for n in names) and len({n.strip() for n in names}) == len(names)
    if not named or not rest or any(mark in data for mark in _MARKS):
        return None
    try:
        header = [n.decode() for n in names]
        return csv.read_csv(
            pa.BufferReader(data),
            csv.ReadOptions(use_threads=False, block_size=len(data) + 1),
            csv.ParseOptions(quote_char=False),
            csv.ConvertOptions(
                column_types=dict.fromkeys(header, pa.string()), null_values=NULL_TOKENS, strings_can_be_null=True
            ),
        )
    except (pa.ArrowInvalid, UnicodeDecodeError):
        return None


def _entry_chunks(archive: zipfile.ZipFile, entry: str) -> Iterator[tuple[list[str], int, dict[str, pa.Array]]]:
    """Names as written, the number of rows and the log's columns, by stripped name, of each chunk."""
    with archive.open(entry) as stream:
        source = stream
        if archive.getinfo(entry).file_size <= _SMALL_BYTES:
            data = stream.read()
            plain = _plain_table(data)
            if plain is not None:
                plain = plain.combine_chunks()
                columns = {c.strip(): plain.column(i) for i, c in enumerate(plain.column_names)}
                yield [*columns], plain.num_rows, {c: columns[c].combine_chunks() for c in LOG_COLUMNS if c in columns}
                return
            source = io.BytesIO(data)
        for chunk in pd.read_csv(source, dtype=str, index_col=False, chunksize=_CHUNK_ROWS):
            header = [str(c).strip() for c in chunk.columns]
            chunk.columns = header
            yield header, len(chunk), {c: pa.array(chunk[c], pa.string(), from_pandas=True) for c in LOG_COLUMNS if c in header}


def _entry_batches(archive: zipfile.ZipFile, path: str, entry: str, name: str | None = None) -> Iterator[pa.RecordBatch]:
    """``name`` is what the rows give as their file, the entry's own by default."""
    names = [f.name for f in RAW_SCHEMA]
    first = 0
    for header, n, columns in _entry_chunks(archive, entry):
        if n:
            text = [columns[c] if c in columns else pa.nulls(n, pa.string()) for c in LOG_COLUMNS]
            origin = [
                pa.repeat(pa.scalar(path, pa.string()), n),
                pa.repeat(pa.scalar(name or entry, pa.string()), n),
                pa.array(np.arange(first, first + n), pa.int64()),
                pa.repeat(pa.scalar(header, _HEADER_TYPE), n),
            ]
            yield pa.RecordBatch.from_arrays([*origin, *text], names=names)
            first += n


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``_BATCH_ROWS`` or more, but for the last; a batch costs as much as hundreds of rows."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= _BATCH_ROWS:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, rows = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def unpack_archives(contents: DataFrame) -> DataFrame:
    """From ``path, content`` (one archive per row, as ``binaryFile`` reads them) to raw log rows."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                with zipfile.ZipFile(pa.BufferReader(content.as_buffer())) as archive:
                    for entry in csv_entries(archive, path.as_py()):
                        yield from _entry_batches(archive, path.as_py(), entry)

    ship_code()
    return contents.select("path", "content").mapInArrow(unpack, RAW_SCHEMA)


def archive_entries(contents: DataFrame) -> DataFrame:
    """``archive, source_file`` of every CSV entry, those without rows included. Reads no entry."""

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                with zipfile.ZipFile(pa.BufferReader(content.as_buffer())) as archive:
                    found = csv_entries(archive, path.as_py())
                columns = [pa.array([path.as_py()] * len(found)), pa.array(found)]
                yield pa.RecordBatch.from_arrays(columns, names=["archive", "source_file"])

    ship_code()
    return contents.select("path", "content").mapInArrow(names, "archive string, source_file string")


def archive_contents(spark: SparkSession, path: str) -> DataFrame:
    """``path, content`` of one archive, a glob or a folder of archives."""
    files = spark.read.format("binaryFile")
    if not path.endswith(".zip"):
        files = files.option("pathGlobFilter", "*.zip")
    return files.load(path).select("path", "content")


def archive_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, modificationTime, length`` of one archive, a glob or a folder of archives; no content is read."""
    files = spark.read.format("binaryFile")
    if not path.endswith(".zip"):
        files = files.option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true")
    return files.load(path).select("path", "modificationTime", "length")


def plan_entries(files: DataFrame) -> DataFrame:
    """``archive, entry, packed_bytes`` of every CSV entry. Tasks read the directories at the archives' ends, no entry."""

    def directories(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, names, sizes = [], [], []
            for path in batch.column("path").to_pylist():
                with open_file(path) as raw, zipfile.ZipFile(raw) as archive:
                    found = csv_entries(archive, path)
                    paths += [path] * len(found)
                    names += found
                    sizes += [archive.getinfo(name).compress_size for name in found]
            columns = [pa.array(paths, pa.string()), pa.array(names, pa.string()), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["archive", "entry", "packed_bytes"])

    ship_code()
    spread = files.select("path").repartition(_LISTING_PARTS, F.xxhash64("path"))
    return spread.mapInArrow(directories, "archive string, entry string, packed_bytes bigint")


def entry_files(spark: SparkSession, path: str) -> DataFrame:
    """``source_file`` of every CSV entry as ``read_archives`` names it, those without rows included."""
    files = archive_files(spark, path)
    folder, archives = common_folder(files)
    entries = plan_entries(files)
    if archives < 2:
        return entries.select(F.col("entry").alias("source_file"))
    return entries.select(F.concat(F.substr("archive", F.lit(len(folder) + 1)), F.lit("/"), "entry").alias("source_file"))


def dealt_entries(planned: DataFrame, task_bytes: int = _TASK_BYTES) -> tuple[DataFrame, int]:
    """The entries with ``task``, a number from 0 on, so that each task has about ``task_bytes`` packed bytes or one
    larger entry; and how many tasks there are.

    Entries are laid end to end, archive by archive, and cut every ``task_bytes``: running sums inside the archives,
    on top of sums of whole archives in buckets. The driver sees one sum a bucket.
    """
    bucket = F.pmod(F.xxhash64("archive"), F.lit(_LISTING_PARTS))
    weighed = planned.withColumns({"bucket": bucket, "weight": F.col("packed_bytes") + _ENTRY_BYTES})
    sums = {r.bucket: r.total for r in weighed.groupBy("bucket").agg(F.sum("weight").alias("total")).collect()}
    before, total = [], 0
    for number in range(_LISTING_PARTS):
        before.append(total)
        total += sums.get(number, 0)
    running = F.sum("weight").over(W.partitionBy("bucket").orderBy("archive", "entry").rowsBetween(W.unboundedPreceding, -1))
    start = F.get(F.array(*[F.lit(b) for b in before]), F.col("bucket").cast("int")) + F.coalesce(running, F.lit(0))
    task = C.integer_div(start, F.lit(task_bytes)).cast("int")
    return weighed.withColumn("task", task).drop("bucket", "weight"), total // task_bytes + 1


def common_folder(files: DataFrame) -> tuple[str, int]:
    """The folder that all archives lie below, and how many there are."""
    found = files.agg(F.min("path").alias("low"), F.max("path").alias("high"), F.count("path").alias("n")).first()
    shared = posixpath.commonprefix([found.low, found.high]) if found.n else ""
    return shared[: shared.rfind("/") + 1], found.n


def entry_rows(entries: DataFrame, folder: str, tasks: int) -> DataFrame:
    """Raw log rows of ``archive, entry, task``; ``folder`` is cut from the archive's path in ``source_file``, and with
    an empty one the file has the entry's name alone. A task opens an archive once for all its entries."""

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = (pair for b in batches for pair in zip(b.column("archive").to_pylist(), b.column("entry").to_pylist()))
        for path, own in itertools.groupby(pairs, key=lambda pair: pair[0]):
            with open_file(path) as raw, zipfile.ZipFile(raw) as archive:
                for _, entry in own:
                    name = f"{path.removeprefix(folder)}/{entry}" if folder else entry
                    yield from _entry_batches(archive, path, entry, name)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _gathered(unpacked(batches))

    ship_code()
    dealt = entries.select("archive", "entry", "task").repartitionById(tasks, "task").sortWithinPartitions("archive", "entry")
    return dealt.select("archive", "entry").mapInArrow(read, RAW_SCHEMA)


def read_files(files: DataFrame, folder: str | None = None, task_bytes: int = _TASK_BYTES) -> DataFrame:
    """Raw log rows of the archives listed in ``files`` (``path``), their entries dealt out by size.

    The plan of entries is written to the shared folder once, by a job that runs here; what is read from it later does
    not depend on the archives' directories again. ``folder`` fixes the names of files; by default it follows from
    the list: empty for a lone archive, else the folder common to all.
    """
    spark = files.sparkSession
    if folder is None:
        folder, archives = common_folder(files)
        folder = folder if archives > 1 else ""
    path = scratch_path(spark, "entries")
    plan_entries(files).write.parquet(path)
    planned = spark.read.schema("archive string, entry string, packed_bytes bigint").parquet(path)
    entries, tasks = dealt_entries(planned, task_bytes)
    return entry_rows(entries, folder, tasks)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """All CSV entries of one archive, a glob or a folder of archives, as raw rows with their origin.

    Two stages: tasks read the directories of the archives, then entries are dealt out so that tasks have equal packed
    bytes, and are streamed from storage, whatever the archive's size. ``source_file`` is the entry's name, with the
    archive's before it when there are several, so that equal entries stay apart. A folder without archives has no
    rows. Spark lists the archives; pyarrow must be able to open them. ``unpack_archives(archive_contents(...))``
    serves other stores, for archives under 2 GB.
    """
    return read_files(archive_files(spark, path))
