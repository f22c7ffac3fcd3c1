"""Token ids in Arrow files: equal-length sequences and masks, readable at any place without copying."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from epochwise.llm import runs
from epochwise.session import materialize

BATCH = 256  # sequences of a record batch; all but the last of a file are full


# How a tokenizer of lower-case words splits text, and the letters and marks for which that is
# plain: lower case is one character each, nothing is composed, and runs of letters and of marks are apart.
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ.,]+")
PLAIN_PARTS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+|[.,]+")


SPACE = re.compile(rb"\s")


def stretches(raw: bytes, most: int = 1 << 18) -> Iterator[bytes]:
    """A text in parts of about ``most`` bytes that end before white space, so that the pieces of a long one never are a list together."""
    a = 0
    while a < len(raw):
        found = SPACE.search(raw, a + most)
        b = found.start() if found else len(raw)
        yield raw[a:b]
        a = b


class Parts(dict):
    """Ids of runs of plain letters or marks, by the tokenizer's model alone."""

    def __init__(self, tokenizer, dtype: np.dtype, most: int) -> None:
        super().__init__()
        self.encode, self.dtype, self.most = tokenizer.model.tokenize, dtype, most
        # Bytes as characters, as byte-level models write them: visible ones as they are, the others from 256 on.
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in visible]
        self.letters = {b: b for b in visible} | {b: 256 + k for k, b in enumerate(hidden)}

    def __missing__(self, part: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        out = self[part] = np.array([t.id for t in self.encode(part.encode().decode("latin-1").translate(self.letters))], self.dtype).tobytes()
        return out


class Pieces(dict):
    """Ids of white-space separated pieces, as bytes of ``dtype``; looked up, or encoded when missing.

    Emptied when it holds ``most`` pieces, so its memory is bounded. Pieces of plain letters and marks skip the
    tokenizer's slow general splitting where its configuration is the one of ``WORD_SPLIT``.
    """

    def __init__(self, model: str, dtype: np.dtype, most: int = 600_000) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.dtype, self.most = Tokenizer.from_str(model), dtype, most
        setting = json.loads(model)
        split = (setting.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        plain = [n.get("type") for n in (setting.get("normalizer") or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        plain = plain and [x.get("type") for x in split] == ["Split", "ByteLevel"] and split[0]["pattern"] == {"Regex": WORD_SPLIT}
        plain = plain and not split[1]["add_prefix_space"] and not split[1]["use_regex"]
        self.parts = Parts(self.tokenizer, dtype, most) if plain else None

    def __missing__(self, piece: bytes) -> bytes:
        if len(self) >= self.most:
            self.clear()
        text = piece.decode()
        if self.parts is not None and PLAIN.fullmatch(text):
            out = b"".join(map(self.parts.__getitem__, PLAIN_PARTS.findall(text.lower())))
        else:
            out = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()
        self[piece] = out
        return out


def schema(dtype: np.dtype, length: int) -> pa.Schema:
    return pa.schema([pa.field("input_ids", pa.list_(pa.from_numpy_dtype(dtype), length)), pa.field("mask", pa.list_(pa.bool_(), length))])


class Writer:
    """Streams ids into one Arrow file; memory holds one record batch. The last sequence is padded with 0."""

    def __init__(self, sink, dtype: np.dtype, length: int) -> None:
        self.dtype, self.length, self.n = dtype, length, 0
        self.out = pa.ipc.new_file(sink, schema(dtype, length))
        self.held, self.size = [], 0

    def add(self, ids: bytes) -> None:
        self.held.append(ids)
        self.size += len(ids)
        step = BATCH * self.length * self.dtype.itemsize
        if self.size >= step:
            data = b"".join(self.held)
            whole = len(data) // step * step
            for a in range(0, whole, step):
                self._batch(data[a : a + step])
            self.held, self.size = [data[whole:]], len(data) - whole

    def _batch(self, data: bytes) -> None:
        n = len(data) // self.dtype.itemsize
        rows = -(-n // self.length)
        ids = np.zeros(rows * self.length, self.dtype)
        ids[:n] = np.frombuffer(data, self.dtype)
        mask = np.arange(rows * self.length) < n
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.out.write_batch(pa.record_batch(columns, schema=schema(self.dtype, self.length)))

    def close(self) -> None:
        if self.size:
            self._batch(b"".join(self.held))
        self.out.close()


class Reader:
    """Random access to a file of ``Writer``; arrays are views of the mapped file where the store is local."""

    def __init__(self, path: str) -> None:
        system, name = pafs.FileSystem.from_uri(path)
        local = isinstance(system, pafs.LocalFileSystem)
        self.file = pa.ipc.open_file(pa.memory_map(name) if local else system.open_input_file(name))
        self.length = self.file.schema.field("input_ids").type.list_size
        self.at, self.ids = -1, None

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of sequence ``i``."""
        batch = self.file.get_batch(i // BATCH)
        row = slice(i % BATCH, i % BATCH + 1)
        ids, mask = (batch.column(c)[row].flatten() for c in ("input_ids", "mask"))
        return ids.to_numpy(), mask.to_numpy(zero_copy_only=False)

    def tokens(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from place ``start`` of the file; a view unless a batch ends in between."""
        step, parts = BATCH * self.length, []
        while n > 0:
            k, a = divmod(start, step)
            if k != self.at:
                self.at, self.ids = k, self.file.get_batch(k).column("input_ids").flatten().to_numpy()
            parts.append(self.ids[a : a + n])
            start, n = start + len(parts[-1]), n - len(parts[-1])
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _put(folder: str, name: str, write) -> str:
    """Write a file under another name first, so that a lost or repeated task leaves no half of one."""
    system, base = pafs.FileSystem.from_uri(folder)
    context = TaskContext.get()
    draft, final = f"{base}/.{name}-{context.taskAttemptId()}", f"{base}/{name}"
    with system.open_output_stream(draft) as sink:
        write(sink)
    system.move(draft, final)
    return f"{folder}/{name}"


def write_tokens(
    docs: DataFrame, folder: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, length: int = 2048, by_piece: bool = True
) -> DataFrame:
    """Encode all texts in ascending order of id and write them below ``folder``; returns the files.

    Ids are dealt out by ranges, so file ``k`` holds the documents before those of file ``k + 1``. Every text
    (null: empty) gets ``end_id`` at its end; the ids of a file's documents follow each other and are cut into
    sequences of ``length``; the last one is padded, with false in the mask. Beside each file lies one with
    ``doc_id, start, n_tokens``, places counting from the start of the file. Ids are stored in 16 bits where
    the vocabulary allows. Rows ``(part, path, docs_path, n_tokens, base)``, ``base`` the number of ids in all files before.

    ``by_piece``: encode white-space separated pieces and remember them; right for tokenizers that drop
    white space and split at it. Otherwise every text is encoded as a whole.

    ``folder`` has to be reachable from all executors. Null ids sort last. Rows that share an id are ordered by a hash of the text.
    """
    from tokenizers import Tokenizer

    with open(tokenizer_path, encoding="utf-8") as f:
        model = f.read()
    dtype = np.dtype("<u2" if max(Tokenizer.from_str(model).get_vocab_size() - 1, end_id) < 1 << 16 else "<u4")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    system, base = pafs.FileSystem.from_uri(folder)
    system.create_dir(base, recursive=True)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = runs.worker_slot("pieces", (zlib.crc32(sent.value.encode()), str(dtype)), lambda: Pieces(sent.value, dtype))
        end = np.array([end_id], dtype).tobytes()
        ids, starts, sizes, at = [], [], [], 0
        name = f"part-{TaskContext.get().partitionId():06d}"

        def encoded() -> Iterator[bytes]:
            nonlocal at
            for batch in runs.small_batches(batches, "text"):
                texts, own = batch.column("text").to_pylist(), batch.column("own").to_pylist()
                for text, i in zip(texts, own):
                    if by_piece:
                        data = b"".join(b"".join(map(pieces.__getitem__, part.split())) for part in stretches(text.encode())) + end
                    else:
                        data = np.array(pieces.tokenizer.encode(text, add_special_tokens=False).ids, dtype).tobytes() + end
                    n = len(data) // dtype.itemsize
                    ids.append(i)
                    starts.append(at)
                    sizes.append(n)
                    at += n
                    yield data

        def write(sink) -> None:
            writer = Writer(sink, dtype, length)
            for data in encoded():
                writer.add(data)
            writer.close()

        def write_docs(sink) -> None:
            table = pa.table({"doc_id": pa.array(ids, pa.int64()), "start": pa.array(starts, pa.int64()), "n_tokens": pa.array(sizes, pa.int64())})
            with pa.ipc.new_file(sink, table.schema) as out:
                out.write_table(table)

        path = _put(folder, f"{name}.arrow", write)
        docs_path = _put(folder, f"{name}.docs.arrow", write_docs)
        yield pa.record_batch([pa.array([int(name[5:])]), pa.array([path]), pa.array([docs_path]), pa.array([at])], ["part", "path", "docs_path", "n_tokens"])

    ident, tag, text = runs.identified(docs, id_col, text_col)
    rows = docs.select(ident, tag, F.col(id_col).cast("long").alias("own"), text).repartitionByRange("id", "tag").sortWithinPartitions("id", "tag")
    files = materialize(rows.mapInArrow(task, "part long, path string, docs_path string, n_tokens long"), "token-files")
    # One row per file.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_documents(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Per document, read from the files: ``doc_id, start, n_tokens, ids_crc32``; ``start`` counts over all files."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                reader = Reader(row["path"])
                system, name = pafs.FileSystem.from_uri(row["docs_path"])
                with system.open_input_file(name) as f:
                    docs = pa.ipc.open_file(f).read_all()
                starts, sizes = docs["start"].to_numpy(), docs["n_tokens"].to_numpy()
                crc = [zlib.crc32(reader.tokens(int(a), int(n)).astype("<u4").tobytes()) for a, n in zip(starts, sizes)]
                table = pa.table({"doc_id": docs["doc_id"], "start": pa.array(starts + row["base"]), "n_tokens": docs["n_tokens"], "ids_crc32": pa.array(crc, pa.int64())})
                yield from table.to_batches()

    files = materialize(files, "token-bases")
    return files.repartition(max(1, files.count())).mapInArrow(task, "doc_id long, start long, n_tokens long, ids_crc32 long")
