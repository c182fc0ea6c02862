"""Token ids as flat binary files with document offsets, and their reader.

Documents go to files by ranges of doc_id, ascending. A file set is

* `<name>.bin`: the ids, unsigned little-endian, 16 bits wide if the vocabulary allows, else 32,
* `<name>.idx`: 64-bit offsets, one per document and the end, in ids from the file's beginning,
* `<name>.doc`: the 64-bit doc_id of every document.

Tasks write under names of their own and tell them in the index table, which
is stored before anything is read: a task that runs twice leaves a file nobody
reads. The place of a file in the whole sequence is a prefix sum over the
index. Readers map the files into memory where the folder is a local path, and
read them through the store's own client elsewhere.

Defined results: null and empty texts have the end id only. Rows that share a
doc_id follow each other, ordered by text. Rows with a null doc_id are not
written: the format has no place for them. Further columns are not read. An
empty table gives an empty index and an empty result.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wiregrid.llm.common import batches_of, parts_for, text_bytes
from wiregrid.llm.tokens import encode_ended, encoder, keeps_white
from wiregrid.session import materialize, scratch_dir

#: Bytes of text that go to one file.
FILE_TEXT = 32_000_000


def _opened(folder: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(folder)


def _read(folder: str, name: str, kind: str) -> np.ndarray:
    from pyarrow.fs import LocalFileSystem

    store, path = _opened(folder)
    if isinstance(store, LocalFileSystem):
        size = store.get_file_info(f"{path}/{name}").size
        return np.memmap(f"{path}/{name}", kind, "r") if size else np.zeros(0, kind)
    with store.open_input_file(f"{path}/{name}") as file:
        return np.frombuffer(file.read(), kind)


def write_tokens(docs: DataFrame, tokenizer: str, folder: str | None = None) -> DataFrame:
    """Writes the ids of `docs` (doc_id, text) and returns the stored index.

    Index rows: part, folder, name, width, n_docs, n_tokens and base, the ids in all files before.
    """
    spark = docs.sparkSession
    folder = folder or f"{scratch_dir(spark)}/tokens"
    texts = docs.select("doc_id", "text").where("doc_id IS NOT NULL")
    dealt = texts.repartitionByRange(
        parts_for(text_bytes(texts), FILE_TEXT), "doc_id"
    ).sortWithinPartitions("doc_id", "text")

    def run(rows: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        worker = encoder(tokenizer, keeps_white)
        width = 2 if worker.tokenizer.get_vocab_size() <= 1 << 16 else 4
        store, path = _opened(folder)
        store.create_dir(path, recursive=True)
        name = f"part-{uuid.uuid4().hex}"
        sizes, doc_ids = [np.zeros(1, np.uint64)], []
        with store.open_output_stream(f"{path}/{name}.bin") as out:
            for batch, found in batches_of(rows, "text"):
                ids, first = encode_ended(worker, found, 0)
                out.write(ids.astype(f"<u{width}").tobytes())
                sizes.append(np.diff(first).astype(np.uint64))
                doc_ids.append(batch.column("doc_id").to_numpy(zero_copy_only=False))
        offsets = np.cumsum(np.concatenate(sizes), dtype=np.uint64)
        held = np.concatenate(doc_ids) if doc_ids else np.zeros(0, np.int64)
        for ending, values in (("idx", offsets.astype("<u8")), ("doc", held.astype("<i8"))):
            with store.open_output_stream(f"{path}/{name}.{ending}") as out:
                out.write(values.tobytes())
        part = TaskContext.get().partitionId()
        row = [part, folder, name, width, len(held), int(offsets[-1])]
        names = ["part", "folder", "name", "width", "n_docs", "n_tokens"]
        yield pa.RecordBatch.from_pylist(
            [dict(zip(names, row, strict=True))] if len(held) else [],
            schema=pa.schema(
                [("part", pa.int32()), ("folder", pa.string()), ("name", pa.string()),
                 ("width", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]
            ),
        )

    index, _ = materialize(
        dealt.mapInArrow(
            run, "part int, folder string, name string, width int, n_docs long, n_tokens long"
        ),
        "token-index",
    )
    # One row per file.
    before = F.sum("n_tokens").over(Window.orderBy("part")) - F.col("n_tokens")
    return index.withColumn("base", before)


def read_tokens(index: DataFrame, ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files, with `ids` if asked for."""
    files = max(index.count(), 1)

    def run(rows: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in rows:
            for row in batch.to_pylist():
                flat = _read(row["folder"], row["name"] + ".bin", f"<u{row['width']}")
                offsets = _read(row["folder"], row["name"] + ".idx", "<u8").astype(np.int64)
                docs = _read(row["folder"], row["name"] + ".doc", "<i8")
                step = 5000
                for a in range(0, len(docs), step):
                    b = min(a + step, len(docs))
                    values = np.asarray(flat[offsets[a] : offsets[b]]).astype("<u4")
                    raw = values.tobytes()
                    cuts = (4 * (offsets[a : b + 1] - offsets[a])).tolist()
                    columns = [
                        pa.array(np.asarray(docs[a:b]), pa.int64()),
                        pa.array(row["base"] + offsets[a:b], pa.int64()),
                        pa.array(np.diff(offsets[a : b + 1]), pa.int64()),
                        pa.array(
                            [zlib.crc32(raw[x:y]) for x, y in zip(cuts, cuts[1:], strict=False)],
                            pa.int64(),
                        ),
                    ]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    if ids:
                        ends = pa.array((offsets[a : b + 1] - offsets[a]).astype(np.int32))
                        columns.append(
                            pa.ListArray.from_arrays(ends, pa.array(values.astype(np.int64)))
                        )
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids
    # A file per task.
    return index.repartition(files).mapInArrow(run, schema)
