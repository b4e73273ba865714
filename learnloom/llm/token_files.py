"""Token ids as flat binary files with 64-bit offsets, in ascending document order.

Layout of a written folder: for each part ``p`` (parts are ranges of ids, in order) ``tokens-p.bin`` holds the ids of
its documents one after another as unsigned little-endian integers of the smallest width that holds the vocabulary
(16 or 32 bits), and ``offsets-p.bin`` holds ``n + 1`` unsigned 64-bit token offsets within the part, followed by the
``n`` document ids as signed 64-bit integers (the smallest value stands for null). ``parts.json`` lists for each part
its documents, its tokens and its base, the prefix sum of the tokens of all parts before it; a document's global offset
is its part's base plus its own offset.

Files go to the shared folder through Arrow's file systems under a name of their own attempt and are then renamed, so
a task that runs twice, or an executor that is lost midway, leaves whole files only.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_path, shuffle_partitions
from .tokens import default_path, encoder

NULL_ID = -(2**63)


def _place(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _write(system, path: str, attempt: str, parts: Iterable[bytes]) -> None:
    """Writes under a name of the attempt, then renames. All attempts write the same bytes, so where one has finished, a
    later one, a speculative one say, drops its own file: readers always find a whole file."""
    from pyarrow import fs

    own = f"{path}.{attempt}"
    try:
        with system.open_output_stream(own) as out:
            for x in parts:
                out.write(x)
        if system.get_file_info(path).type == fs.FileType.NotFound:
            system.move(own, path)
        else:
            system.delete_file(own)
    except BaseException:
        if system.get_file_info(own).type != fs.FileType.NotFound:
            system.delete_file(own)
        raise


def _listed(folder: str):
    from pyarrow import fs

    return fs.FileSelector(folder, allow_not_found=True)


def _mapped(system, path: str, dtype: str) -> np.ndarray:
    """The file as an array: memory-mapped where the file system is local to the worker, else read."""
    from pyarrow import fs

    if isinstance(system, fs.LocalFileSystem):
        with pa.memory_map(path) as f:
            return np.frombuffer(f.read_buffer(), dtype)
    with system.open_input_file(path) as f:
        return np.frombuffer(f.read_buffer(), dtype)


def write_token_files(
    docs: DataFrame, uri: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", parts: int = 0
) -> list[dict]:
    """Writes the files below ``uri`` and returns the entries of parts.json, one for each part.

    A null text is encoded as the empty text, so its document has the end id only. A null id sorts first. Rows that repeat
    an id follow each other in order of their texts' hashes, so that they may lie in several parts. An empty table writes
    parts without documents. Other columns are ignored. What the folder held before is removed.
    """
    spark = docs.sparkSession
    parts = parts or shuffle_partitions(spark)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, encode = TaskContext.get(), encoder(tokenizer_path)
        width = "<u2" if max(end_id, encode.tokenizer.get_vocab_size() - 1) < 2**16 else "<u4"
        part, attempt = task.partitionId(), str(task.taskAttemptId())
        end, lengths, ids = np.array([end_id], width).tobytes(), [], []
        system, folder = _place(uri)

        def tokens() -> Iterator[bytes]:
            for batch in batches:
                ids.extend(NULL_ID if i is None else i for i in batch.column(0).to_pylist())
                texts = batch.column(1)
                for k in range(0, len(texts), 64):
                    for x in encode.encode(texts.slice(k, 64).to_pylist()):
                        lengths.append(len(x) // 4 + 1)
                        yield np.frombuffer(x, "<u4").astype(width).tobytes()
                        yield end

        _write(system, f"{folder}/tokens-{part:05d}.bin", attempt, tokens())
        offsets = np.concatenate([[0], np.cumsum(lengths, dtype=np.uint64)]).astype("<u8")
        _write(system, f"{folder}/offsets-{part:05d}.bin", attempt, [offsets.tobytes(), np.array(ids, "<i8").tobytes()])
        yield pa.RecordBatch.from_pydict({"part": [part], "docs": [len(ids)], "tokens": [int(offsets[-1])], "width": [int(width[-1])]})

    system, folder = _place(uri)
    if system.get_file_info(folder).is_file or any(f.is_file for f in system.get_file_info(_listed(folder))):
        system.delete_dir(folder)
    system.create_dir(folder)
    ordered = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("hash"), F.monotonically_increasing_id().alias("row"))
        .repartitionByRange(parts, "doc_id", "hash", "row")
        .sortWithinPartitions("doc_id", "hash", "row")
        .select("doc_id", "text")
    )
    # One row for each part comes back, so this is bounded by the number of partitions.
    found = sorted(ordered.mapInArrow(write, "part long, docs long, tokens long, width long").collect())
    bases = np.concatenate([[0], np.cumsum([r["tokens"] for r in found], dtype=np.int64)])
    listed = [r.asDict() | {"base": int(b)} for r, b in zip(found, bases)]
    _write(system, f"{folder}/parts.json", "new", [json.dumps(listed).encode()])
    return listed


def read_token_files(spark: SparkSession, uri: str, with_ids: bool = False) -> DataFrame:
    """One row per document of a written folder: doc_id, start (global), n_tokens, ids_crc32 and, if asked, ids (binary).

    ``ids_crc32`` is taken over the ids as unsigned little-endian 32-bit integers; so is ``ids``.
    """
    system, folder = _place(uri)
    with system.open_input_stream(f"{folder}/parts.json") as f:
        listed = json.loads(f.read())
    entries = {p["part"]: (p["base"], p["width"]) for p in listed if p["docs"]}
    numbers = sorted(entries)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = _place(uri)
        for k in (i for b in batches for i in b.column(0).to_pylist()):
            part = numbers[k]
            base, width = entries[part]
            tokens = _mapped(system, f"{folder}/tokens-{part:05d}.bin", f"<u{width}")
            both = _mapped(system, f"{folder}/offsets-{part:05d}.bin", "<u8")
            n = (len(both) - 1) // 2
            offsets, ids = both[: n + 1].astype(np.int64), both[n + 1 :].view("<i8").tolist()
            for at in range(0, n, 512):
                to = min(n, at + 512)
                whole = [tokens[offsets[i] : offsets[i + 1]].astype("<u4").tobytes() for i in range(at, to)]
                columns = [
                    pa.array([None if i == NULL_ID else i for i in ids[at:to]], pa.int64()),
                    pa.array(offsets[at:to] + base, pa.int64()),
                    pa.array(np.diff(offsets[at : to + 1]), pa.int64()),
                    pa.array([zlib.crc32(x) for x in whole], pa.int64()),
                ] + [pa.array(whole, pa.binary())] * with_ids
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    return spark.range(0, len(numbers), 1, max(1, len(numbers))).mapInArrow(read, schema)


def token_files(docs: DataFrame, tokenizer_path: str | None = None, end_id: int = 2, uri: str | None = None) -> DataFrame:
    """Writes the files (below the shared folder unless ``uri`` is given) and returns what :func:`read_token_files` reads back."""
    spark = docs.sparkSession
    uri = uri or shared_path(spark)
    write_token_files(docs, uri, tokenizer_path or default_path(), end_id)
    return read_token_files(spark, uri)
