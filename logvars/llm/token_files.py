"""Token ids in Arrow files of fixed-size lists, read back by position without copying.

One file holds the ids of a range of documents, one document after the other, cut into sequences
of equal length; a mask tells the last sequence's padding.  Sequence *i* of a file is row
``i % ROWS`` of record batch ``i // ROWS``, a view into the mapped file.  The index (one row per
document: file, first id in it, number of ids, first id in the whole order) is a Parquet table.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import filesystem, id_ranges, range_count, range_of, shared_dir, stage
from .tokens import encoder

#: Sequences in a record batch.
ROWS = 64
INDEX = "doc_id long, range int, file string, first long, n_tokens long"


def _schema(length: int, narrow: bool) -> pa.Schema:
    """Ids take two bytes where the whole vocabulary fits; masks take a bit."""
    return pa.schema([("ids", pa.list_(pa.uint16() if narrow else pa.uint32(), length)), ("mask", pa.list_(pa.bool_(), length))])


class TokenFileWriter:
    """Appends documents' ids; holds one record batch in memory."""

    def __init__(self, folder: str, name: str, length: int, narrow: bool):
        self.name, self.length, self.written = name, length, 0
        self.schema = _schema(length, narrow)
        self.waiting: list[bytes] = []
        self.size = 0
        fs, path = filesystem(folder)
        fs.create_dir(path, recursive=True)
        self.sink = fs.open_output_stream(f"{path}/{name}")
        self.writer = pa.ipc.new_file(self.sink, self.schema)

    def append(self, ids: bytes) -> int:
        """Position of the document's first id in this file."""
        first = self.written + self.size
        self.waiting.append(ids)
        self.size += len(ids) // 4
        if self.size >= ROWS * self.length:
            self._flush(last=False)
        return first

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.waiting), dtype="<u4")
        batch = ROWS * self.length
        for at in range(0, len(ids) if last else len(ids) - len(ids) % batch, batch):
            self._write(ids[at : at + batch])
        rest = b"" if last else ids[len(ids) - len(ids) % batch :].tobytes()
        self.written += len(ids) - len(rest) // 4
        self.waiting, self.size = [rest], len(rest) // 4

    def _write(self, ids: np.ndarray) -> None:
        rows = -(-len(ids) // self.length)
        full = np.zeros(rows * self.length, dtype=self.schema.field("ids").type.value_type.to_pandas_dtype())
        full[: len(ids)] = ids
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (full, np.arange(len(full)) < len(ids))]
        self.writer.write_batch(pa.record_batch(lists, schema=self.schema))

    def close(self) -> None:
        self._flush(last=True)
        self.writer.close()
        self.sink.close()


class TokenFile:
    """Random access to the sequences of one file; a local file is mapped, so ids are views into it."""

    def __init__(self, folder: str, name: str):
        fs, path = filesystem(folder)
        local = fs.type_name == "local"
        self.source = pa.memory_map(f"{path}/{name}") if local else fs.open_input_file(f"{path}/{name}")
        self.reader = pa.ipc.open_file(self.source)
        self.length = self.reader.schema.field("ids").type.list_size
        self.at = -1

    def _batch(self, number: int) -> tuple[np.ndarray, pa.BooleanArray]:
        if number != self.at:
            batch = self.reader.get_batch(number)
            self.views = batch.column("ids").values.to_numpy(zero_copy_only=True), batch.column("mask").values
            self.at = number
        return self.views

    def sequence(self, number: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Ids and mask of sequence ``number``, both views."""
        ids, mask = self._batch(number // ROWS)
        at = number % ROWS * self.length
        return ids[at : at + self.length], mask[at : at + self.length]

    def span(self, first: int, count: int) -> np.ndarray:
        """``count`` ids from position ``first``; a view where they lie in one record batch."""
        parts, batch = [], ROWS * self.length
        while count > 0:
            ids, mask = self._batch(first // batch)
            at = first % batch
            take = min(count, batch - at)
            if at + take > len(ids) or not mask[at + take - 1].as_py():
                raise ValueError(f"ids {first} to {first + take} lie beyond the end of the file")
            parts.append(ids[at : at + take])
            first, count = first + take, count - take
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.empty(0, np.uint32)


def write_token_files(
    docs: DataFrame,
    tokenizer: str,
    chunks: str | None,
    end_id: int,
    length: int = 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
    folder: str | None = None,
) -> DataFrame:
    """Write the ids of every whole text plus ``end_id`` in ascending id order; return the index.

    Null and empty texts hold the end id only.  Rows with the same id are kept, ordered by text; null
    ids come first.  No rows: no files.  Other columns are left out, whatever their names.  A task
    that runs again writes a file under a new name, and only files named in the index count.

    Index: doc_id, range, file, first (position in the file), n_tokens, start (ids before it in all
    files), folder.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark).rstrip('/')}/token-files-{uuid.uuid4().hex}"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = range_count(spark)
    bounds = id_ranges(rows, "doc_id", parts)
    ranged = (
        rows.withColumn("range", range_of(F.col("doc_id"), bounds))
        .repartition(parts // 4, "range")
        .sortWithinPartitions("range", "doc_id", "text")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, open_file, current = encoder(tokenizer, chunks).encode, None, None
        narrow = max(encoder(tokenizer, chunks).tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16
        end = int(end_id).to_bytes(4, "little")
        for batch in batches:
            out = []
            ids = encode(batch.column("text").to_pylist())
            for doc, rng, found in zip(batch.column("doc_id").to_pylist(), batch.column("range").to_pylist(), ids, strict=True):
                if rng != current:
                    if open_file:
                        open_file.close()
                    current, open_file = rng, TokenFileWriter(folder, f"range-{rng:07d}-{uuid.uuid4().hex}.arrow", length, narrow)
                out.append((doc, rng, open_file.name, open_file.append(found + end), len(found) // 4 + 1))
            names = ("doc_id", "range", "file", "first", "n_tokens")
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)
        if open_file:
            open_file.close()

    index = stage(ranged.mapInArrow(write, INDEX), "token-index")
    # One row per file, so no more than ranges were asked for.
    files = index.groupBy("range").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    files = files.select("range", F.coalesce(before, F.lit(0)).alias("_before"))
    return index.join(F.broadcast(files), "range").select(
        "doc_id", "range", "file", "first", "n_tokens", (F.col("_before") + F.col("first")).alias("start"), F.lit(folder).alias("folder")
    )


def read_token_files(index: DataFrame, opened: int = 8) -> DataFrame:
    """The index with ``ids`` (little-endian unsigned 32-bit) of each document, read from the files."""
    fields = [f for f in index.schema.fields]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["ids binary"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: OrderedDict[tuple, TokenFile] = OrderedDict()
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch, out = whole.slice(at, 512), []
                columns = (batch.column(c).to_pylist() for c in ("folder", "file", "first", "n_tokens"))
                for folder, name, first, count in zip(*columns, strict=True):
                    key = (folder, name)
                    if key not in files:
                        files[key] = TokenFile(folder, name)
                        if len(files) > opened:
                            files.popitem(last=False)
                    out.append(files[key].span(first, count).astype("<u4").tobytes())
                yield pa.record_batch([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "ids"])

    return index.mapInArrow(read, schema)
