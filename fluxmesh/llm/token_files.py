"""Token ids in Arrow stream files of equal-length sequences.

A file holds the ids of one range of documents, in document order, as record batches of two fixed-size-list columns:
``tokens`` (sequences of ``seq_len`` ids) and ``mask`` (one bit an id, unset for the padding at the file's end). Since every
sequence has the same width, sequence ``i`` of a memory-mapped file is a view into batch ``i // rows_per_batch``: no
bytes are copied. A second stream beside it, ``<file>.index``, holds where each document lies.

Rows: a null text is empty and yields the end id alone; null ids come first; rows with the same id are all written,
ordered by text. An empty table gives no files and no rows. Only ``doc_id`` and ``text`` are read, so other columns of
any name do not matter. A text is encoded whole whatever its length.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import open_fs, scratch
from .wordtokens import encoded_batches

SEQ_LEN = 2048
ROWS_PER_BATCH = 64


def _sequence_batch(ids: np.ndarray, seq_len: int, schema: pa.Schema) -> pa.RecordBatch:
    n = -(-len(ids) // seq_len)
    flat = np.zeros(n * seq_len, ids.dtype)
    flat[: len(ids)] = ids
    mask = np.arange(n * seq_len) < len(ids)
    return pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(x), seq_len) for x in (flat, mask)], schema=schema)


class SequenceWriter:
    """Writes a stream of ids, whatever its pieces, as full batches; the last one is padded."""

    def __init__(self, sink, seq_len: int, rows: int, dtype):
        kind = pa.from_numpy_dtype(np.dtype(dtype))
        self.schema = pa.schema([("tokens", pa.list_(pa.field("item", kind), seq_len)), ("mask", pa.list_(pa.field("item", pa.bool_()), seq_len))], {"seq_len": str(seq_len), "rows_per_batch": str(rows)})
        self.out = pa.ipc.new_stream(sink, self.schema)
        self.seq_len, self.full, self.held, self.size = seq_len, seq_len * rows, [], 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= self.full:
            flat = np.concatenate(self.held)
            for at in range(0, self.size - self.size % self.full, self.full):
                self.out.write_batch(_sequence_batch(flat[at : at + self.full], self.seq_len, self.schema))
            self.held = [flat[self.size - self.size % self.full :].copy()]
            self.size = len(self.held[0])

    def close(self) -> None:
        if self.size:
            self.out.write_batch(_sequence_batch(np.concatenate(self.held), self.seq_len, self.schema))
        self.out.close()


class SequenceFile:
    """Random access to a file's sequences and masks; with a local path they are views of the mapped file."""

    def __init__(self, uri: str):
        fs, path = open_fs(uri)
        self._source = pa.memory_map(path) if fs.type_name == "local" else fs.open_input_file(path)
        reader = pa.ipc.open_stream(self._source)
        meta = reader.schema.metadata
        self.seq_len, self.rows = int(meta[b"seq_len"]), int(meta[b"rows_per_batch"])
        self.batches = list(reader)

    def __len__(self) -> int:
        return sum(b.num_rows for b in self.batches)

    def _view(self, column: int, i: int) -> pa.Array:
        return self.batches[i // self.rows].column(column).values.slice(i % self.rows * self.seq_len, self.seq_len)

    def tokens(self, i: int) -> np.ndarray:
        return self._view(0, i).to_numpy(zero_copy_only=True)

    def mask(self, i: int) -> pa.BooleanArray:
        """A view of the packed bits."""
        return self._view(1, i)

    def span(self, start: int, length: int) -> np.ndarray:
        """The ids ``start .. start + length`` of the file, a view if they lie in one batch."""
        parts, full = [], self.rows * self.seq_len
        while length > 0:
            flat = self.batches[start // full].column(0).values.to_numpy(zero_copy_only=True)
            part = flat[start % full :][:length]
            parts.append(part)
            start, length = start + len(part), length - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint32)


INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
FILES = "path string, first_doc long, n_docs long, n_tokens long"


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, seq_len: int = SEQ_LEN, rows_per_batch: int = ROWS_PER_BATCH, folder: str | None = None) -> list[dict]:
    """Encode and write ``docs(doc_id, text)``; returns the files in document order with the ids before each (``base``).

    The rows are range-partitioned by id before they are encoded, so each text is encoded once and each task writes
    one file. A file's name is new for each attempt, and only files of attempts that succeeded are returned.
    """
    spark = docs.sparkSession
    folder = folder or scratch(spark, "tokens")

    def write(batches):
        fs = sink = seqs = index = None
        rows = tokens = 0
        first = uri = None
        for batch in batches:
            for ids, encoded in encoded_batches(batch, tokenizer):
                if sink is None:
                    uri = f"{folder}/{uuid.uuid4().hex}.arrows"
                    fs, path = open_fs(uri)
                    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    sink, side = fs.open_output_stream(path), fs.open_output_stream(path + ".index")
                    seqs = SequenceWriter(sink, seq_len, rows_per_batch, np.uint16 if end_id < 65536 and _small(tokenizer) else np.uint32)
                    index = pa.ipc.new_stream(side, INDEX)
                    kind = seqs.schema.field("tokens").type.value_type.to_pandas_dtype()
                    first = ids[0]
                sizes = np.array([len(x) // 4 + 1 for x in encoded], np.int64)
                starts = tokens + np.cumsum(sizes) - sizes
                end = np.array([end_id], "<u4").tobytes()
                seqs.add(np.frombuffer(b"".join([y for x in encoded for y in (x, end)]), "<u4").astype(kind))
                index.write_batch(pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts), pa.array(sizes)], schema=INDEX))
                rows, tokens = rows + len(ids), tokens + int(sizes.sum())
        if sink is not None:
            seqs.close()
            index.close()
            sink.close()
            side.close()
            yield pa.RecordBatch.from_pydict({"path": [uri], "first_doc": pa.array([first], pa.int64()), "n_docs": [rows], "n_tokens": [tokens]})

    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    files = sorted((r.asDict() for r in ordered.mapInArrow(write, FILES).collect()), key=lambda r: (r["first_doc"] is not None, r["first_doc"] or 0, r["path"]))
    base = 0
    for f in files:
        f["base"] = base
        base += f["n_tokens"]
    return files


def _small(tokenizer: str) -> bool:
    from .wordtokens import word_encoder

    return word_encoder(tokenizer).lib.get_vocab_size() <= 65536


def read_token_files(spark: SparkSession, files: list[dict]) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in ``files``, read from the files by memory map."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not files:
        return spark.createDataFrame([], schema)

    def read(batches):
        for batch in batches:
            for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = SequenceFile(uri)
                fs, path = open_fs(uri)
                with fs.open_input_stream(path + ".index") as side:
                    for part in pa.ipc.open_stream(side):
                        starts, sizes = part.column(1).to_numpy(), part.column(2).to_numpy()
                        crc = [zlib.crc32(data.span(s, n).astype("<u4")) for s, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(starts + base), part.column(2), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    table = spark.createDataFrame([(f["path"], f["base"]) for f in files], "path string, base long")
    return table.repartition(min(len(files), 4 * spark.sparkContext.defaultParallelism)).mapInArrow(read, schema)
