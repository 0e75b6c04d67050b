"""Token-id files of independent zstandard frames.

A file holds the ids of documents in ascending doc_id order:

    data frames       zstandard frames of whole documents' ids (unsigned 32-bit,
                      little-endian), each with its own content checksum
    directory         a skippable frame: zstandard of (doc_id i64, first i64,
                      frame u32, offset u32, n u32) columns, one entry a document
    seek table        the skippable frame of the public seekable format: for each
                      data frame its compressed size, its plain size and the low
                      32 bits of the XXH64 of its plain bytes; then the number of
                      frames, a descriptor with the checksum bit, and the magic

A plain zstandard reader sees only the data frames.  A reader of this module
seeks to the frames that hold the wanted documents and decompresses no others.

Encoding is by the tokenizers library, on distinct pieces: its byte-level
pre-tokeniser splits a text where :mod:`pieces` does, and no merge crosses a
split, so a text's ids are its pieces' ids in turn.  Texts that hold the string of
an added token (``<|endoftext|>``) are encoded whole, as the library does by default.
A null text is the empty text; every document ends with ``end_id``.  Rows without
a doc_id are left out; rows that repeat an id are written each, in the order of
their texts' hashes, then texts.  A text of any length is one entry of one frame.
An empty table gives no file; other columns are ignored.
"""

from __future__ import annotations

import functools
import os
import struct
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as K
from .pieces import PieceCoder
from .storage import documents, fresh_path, read_table, small_batches

TOKENIZER_FILE = "byte_bpe_50k.json"
END_ID = 0
#: Plain bytes after which a frame is closed (at the end of a document).
FRAME_BYTES = 1 << 17
#: Level of the data frames.
LEVEL = 1

#: Bytes of text for each file, about; there are as many files as that takes, or tasks that run at once.
FILE_BYTES = 32 << 20
#: Pieces that are encoded in one text.
LINES = 2000

SKIPPABLE = 0x184D2A5E
DIRECTORY = 0x184D2A50
SEEKABLE = 0x8F92EAB1
CHECKSUMS = 0x80
ENTRY = np.dtype([("doc_id", "<i8"), ("first", "<i8"), ("frame", "<u4"), ("offset", "<u4"), ("n", "<u4")])
FRAME = np.dtype([("packed", "<u4"), ("plain", "<u4"), ("check", "<u4")])


@functools.lru_cache(maxsize=2)
def coder(path: str) -> PieceCoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    (line_end,) = tokenizer.encode("\n", add_special_tokens=False).ids

    def encode(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Many pieces to a text, a line end after each: it is a piece of its own
        behind anything but white space, so its id marks where pieces end."""
        texts = [p.decode() for p in pieces]
        blank = np.array([t[-1].isspace() for t in texts])
        lines, others = np.flatnonzero(~blank), np.flatnonzero(blank)
        joined = ["".join([texts[k] + "\n" for k in lines[at : at + LINES].tolist()]) for at in range(0, len(lines), LINES)]
        found = [np.array(e.ids, np.int32) for e in tokenizer.encode_batch_fast(joined, add_special_tokens=False)]
        found.extend(np.array([*tokenizer.encode(texts[k], add_special_tokens=False).ids, line_end], np.int32) for k in others.tolist())
        # a blank piece may hold line ends itself: its own length is known
        flat = np.concatenate([np.zeros(0, np.int32), *found])
        ruled = int(sum(map(len, found[: len(joined)])))
        ends = np.concatenate([np.flatnonzero(flat[:ruled] == line_end), ruled - 1 + np.cumsum([len(x) for x in found[len(joined) :]], dtype=np.int64)])
        if len(ends) != len(pieces):
            raise RuntimeError("pieces and lines do not agree")
        size = np.diff(ends, prepend=-1) - 1
        begin = ends - size
        place = np.argsort(np.concatenate([lines, others]), kind="stable")
        size, begin = size[place], begin[place]
        return size, flat[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]

    return LibraryCoder(tokenizer, encode)


class LibraryCoder(PieceCoder):
    """Ids by pieces; of texts with added tokens, by the library at once."""

    def __init__(self, tokenizer, encode) -> None:
        super().__init__(encode)
        self.tokenizer = tokenizer
        self.added = [t.content.encode() for t in tokenizer.get_added_tokens_decoder().values()]

    def documents(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a block's documents and each document's first id."""
        ids, first, _, _ = self.block(data, offs)
        raw = data.tobytes()
        if not any(a in raw for a in self.added):
            return ids, first
        texts = [raw[a:b] for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
        whole = [k for k, t in enumerate(texts) if any(a in t for a in self.added)]
        parts = np.split(ids, first[1:-1])
        for k, e in zip(whole, self.tokenizer.encode_batch_fast([texts[k].decode() for k in whole], add_special_tokens=False), strict=True):
            parts[k] = np.array(e.ids, ids.dtype)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])


class FrameWriter:
    """Writes one file; ``add`` takes whole documents in order."""

    def __init__(self, out) -> None:
        self.out, self.entries, self.frames = out, [], []
        self.pending: list[np.ndarray] = []
        self.held = self.total = 0
        self.pack = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)

    def add(self, doc_ids: np.ndarray, ids: np.ndarray, first: np.ndarray) -> None:
        """Documents whose ids are ``ids[first[k]:first[k + 1]]``."""
        low = 0
        while low < len(doc_ids):
            room = (FRAME_BYTES - self.held) // 4
            high = max(low + 1, int(np.searchsorted(first, first[low] + room, "right")) - 1)
            high = min(high, len(doc_ids))
            part = ids[first[low] : first[high]]
            entry = np.zeros(high - low, ENTRY)
            entry["doc_id"] = doc_ids[low:high]
            entry["first"] = self.total + first[low:high] - first[low]
            entry["frame"] = len(self.frames)
            entry["offset"] = self.held // 4 + first[low:high] - first[low]
            entry["n"] = np.diff(first[low : high + 1])
            self.entries.append(entry)
            self.pending.append(part.astype("<u4"))
            self.held += 4 * len(part)
            self.total += len(part)
            if self.held >= FRAME_BYTES:
                self.close_frame()
            low = high

    def close_frame(self) -> None:
        if self.held:
            plain = np.concatenate(self.pending).tobytes()
            packed = self.pack.compress(plain)
            self.out.write(packed)
            self.frames.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
            self.pending, self.held = [], 0

    def finish(self) -> None:
        self.close_frame()
        entries = np.concatenate(self.entries) if self.entries else np.zeros(0, ENTRY)
        columns = b"".join(np.ascontiguousarray(entries[c]).tobytes() for c in ENTRY.names)
        directory = struct.pack("<I", len(entries)) + zstandard.ZstdCompressor(level=3, write_checksum=True).compress(columns)
        self.out.write(struct.pack("<II", DIRECTORY, len(directory)) + directory)
        table = np.array(self.frames, FRAME).tobytes() + struct.pack("<IBI", len(self.frames), CHECKSUMS, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)


class FrameReader:
    """Reads single documents of one file; ``file`` has seek and read."""

    def __init__(self, file, size: int) -> None:
        self.file = file
        count, _, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE:
            raise ValueError("not a token file")
        begin = size - 9 - FRAME.itemsize * count
        self.frames = np.frombuffer(self._at(begin, FRAME.itemsize * count), FRAME)
        self.begin = np.concatenate([[0], np.cumsum(self.frames["packed"].astype(np.int64))])
        at = int(self.begin[-1])
        kind, length = struct.unpack("<II", self._at(at, 8))
        if kind != DIRECTORY:
            raise ValueError("the directory is missing")
        raw = self._at(at + 8, length)
        (n,) = struct.unpack("<I", raw[:4])
        plain = zstandard.ZstdDecompressor().decompress(raw[4:], max_output_size=n * ENTRY.itemsize) if n else b""
        self.entries, place = np.zeros(n, ENTRY), 0
        for name in ENTRY.names:
            kind = ENTRY[name]
            self.entries[name] = np.frombuffer(plain, kind, n, place)
            place += n * kind.itemsize

    def _at(self, offset: int, n: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(n)

    def frame(self, k: int) -> np.ndarray:
        """The ids of one frame, its checksum verified."""
        f = self.frames[k]
        plain = zstandard.ZstdDecompressor().decompress(self._at(int(self.begin[k]), int(f["packed"])), max_output_size=int(f["plain"]))
        if len(plain) != f["plain"] or xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != f["check"]:
            raise ValueError(f"frame {k} is damaged")
        return np.frombuffer(plain, "<u4")

    def documents(self, wanted: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, list[bytes]]]:
        """Directory entries and ids of all or the wanted documents, frame by frame."""
        entries = self.entries if wanted is None else self.entries[np.isin(self.entries["doc_id"], wanted)]
        cuts = np.flatnonzero(np.diff(entries["frame"].astype(np.int64))) + 1
        for part in np.split(entries, cuts) if len(entries) else []:
            ids = self.frame(int(part["frame"][0]))
            yield part, [ids[o : o + n].tobytes() for o, n in zip(part["offset"].tolist(), part["n"].tolist(), strict=True)]


def _write_rows(folder: str, tokenizer: str, end_id: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        index, attempt = context.partitionId(), context.taskAttemptId()
        fs, path = pafs.FileSystem.from_uri(folder)
        out = writer = None
        low_id = high_id = n_docs = 0
        for batch in batches:
            data, offs = K.text_bytes(batch.column("text"))
            ids = batch.column("doc_id").to_numpy()
            for low, high in K.doc_blocks(offs):
                if writer is None:
                    fs.create_dir(path, recursive=True)
                    out = fs.open_output_stream(f"{path}/_{index:06d}-{attempt}")
                    writer, low_id = FrameWriter(out), int(ids[0])
                tokens, first = coder(tokenizer).documents(data[offs[low] : offs[high]], offs[low : high + 1] - offs[low])
                n = high - low
                full = np.insert(tokens, first[1:], end_id)
                writer.add(ids[low:high], full, first + np.arange(n + 1))
                n_docs, high_id = n_docs + n, int(ids[high - 1])
        if writer is not None:
            writer.finish()
            out.close()
            name = f"part-{index:06d}.tok.zst"
            fs.move(f"{path}/_{index:06d}-{attempt}", f"{path}/{name}")  # a repeated attempt writes the same bytes
            yield pa.RecordBatch.from_pylist([{"file_index": index, "file": name, "first_id": low_id, "last_id": high_id, "n_docs": n_docs, "n_tokens": writer.total}], pa.schema([("file_index", pa.int32()), ("file", pa.string()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    return rows


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, file_bytes: int = FILE_BYTES) -> list[dict]:
    """Write the ids of all documents under ``folder``; the manifest, one row a file, in order.

    ``folder`` is a URI that every executor can write.  Documents are dealt into
    files by ranges of doc_id; rows that repeat an id may take several.
    """
    docs = documents(docs)
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_files = max(docs.sparkSession.sparkContext.defaultParallelism, -(-n_bytes // file_bytes))
    order = ("doc_id", F.xxhash64("text"), "text")
    ordered = docs.repartitionByRange(n_files, *order[:2]).sortWithinPartitions(*order)
    written = ordered.mapInArrow(_write_rows(folder, tokenizer, end_id), "file_index int, file string, first_id long, last_id long, n_docs long, n_tokens long")
    files = sorted((r.asDict() for r in written.collect()), key=lambda r: r["file_index"])
    before = 0
    for f in files:
        f["start"], before = before, before + f["n_tokens"]
    return files


def _read_rows(folder: str, wanted: list[int] | None):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with fs.open_input_file(f"{path}/{name}") as file:
                    reader = FrameReader(file, file.size())
                    for entries, ids in reader.documents(None if wanted is None else np.array(wanted)):
                        yield pa.RecordBatch.from_arrays([pa.array(entries["doc_id"]), pa.array(entries["first"] + start), pa.array(ids, pa.binary())], ["doc_id", "start", "ids"])

    return rows


def read_token_files(spark: SparkSession, folder: str, files: list[dict], wanted: list[int] | None = None) -> DataFrame:
    """``(doc_id, start, ids)`` from the files of a manifest; ``ids`` as little-endian bytes.

    With ``wanted``, only the files and frames that hold those documents are read.
    """
    if wanted is not None:
        files = [f for f in files if any(f["first_id"] <= d <= f["last_id"] for d in wanted)]
    table = spark.createDataFrame([(f["file_index"], f["file"], f["start"]) for f in files], "file_index int, file string, start long")
    spread = table.repartitionByRange(max(1, len(files)), "file_index")
    return spread.mapInArrow(_read_rows(folder, wanted), "doc_id long, start long, ids binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    folder = fresh_path(spark, "op2-tokens")
    files = write_token_files(read_table(spark, sf_dir, "documents"), folder, public_tokenizers.path(TOKENIZER_FILE))
    read = read_token_files(spark, folder, files)
    return read.select("doc_id", "start", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
