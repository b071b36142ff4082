"""Token ids as fixed-width bit-packed files, written and read by the cluster's tasks."""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coverset.llm.common import slices
from coverset.llm.pieces import by_bytes, piece_encoder
from coverset.session import checkpoint_dir, materialise

MAGIC = b"CVTOKBIN"
# Ids in a block: a multiple of 8, so that every block starts on a byte.
BLOCK_IDS = 8_192
# Files at most: their bounds are one list of quantiles on the driver.
MAX_FILES = 10_000


def width_of(vocabulary: int) -> int:
    """Bits of the largest id."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Little-endian bit packing: id k takes bits ``k * bits`` to ``(k + 1) * bits - 1``."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    shifts = np.arange(bits, dtype=np.uint64)
    flags = (ids.astype(np.uint64)[:, None] >> shifts) & np.uint64(1)
    return np.packbits(flags.astype(np.uint8).reshape(-1), bitorder="little").tobytes()


def unpack(raw: bytes, count: int, bits: int) -> np.ndarray:
    """The first ``count`` ids of a packed block."""
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f"<u{bits // 8}", count).astype(np.uint32)
    flags = np.unpackbits(np.frombuffer(raw, np.uint8), count=count * bits, bitorder="little").reshape(count, bits)
    return (flags.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def open_fs(url: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URL (local paths, file, hdfs, s3, gs) and the path in it."""
    return pafs.FileSystem.from_uri(url) if "://" in url else (pafs.FileSystem.from_uri("file://" + os.path.abspath(url.removeprefix("file:"))))


class Writer:
    """One file: header, packed blocks, then the document index, block offsets and a fixed-size footer."""

    def __init__(self, url: str, bits: int):
        self.url, self.bits = url, bits
        self.fs, self.path = open_fs(url)
        self.temporary = f"{self.path}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.temporary)
        self.out.write(MAGIC + struct.pack("<II", bits, BLOCK_IDS))
        self.at, self.total, self.rest = 16, 0, np.empty(0, np.uint32)
        self.offsets: list[int] = []
        self.ids: list[int] = []
        self.lengths: list[int] = []

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        self.ids.append(doc_id)
        self.lengths.append(len(ids))
        self.total += len(ids)
        whole = np.concatenate([self.rest, ids])
        full = len(whole) - len(whole) % BLOCK_IDS
        for k in range(0, full, BLOCK_IDS):
            self._block(whole[k : k + BLOCK_IDS])
        self.rest = whole[full:]

    def _block(self, ids: np.ndarray) -> None:
        raw = pack(ids, self.bits)
        self.offsets.append(self.at)
        self.out.write(raw)
        self.at += len(raw)

    def close(self) -> None:
        if len(self.rest):
            self._block(self.rest)
        self.out.write(np.array(self.ids, "<i8").tobytes() + np.array(self.lengths, "<u8").tobytes() + np.array(self.offsets, "<u8").tobytes())
        self.out.write(struct.pack("<QQQ", len(self.ids), len(self.offsets), self.total) + MAGIC)
        self.out.close()
        self.fs.move(self.temporary, self.path)  # a repeated task replaces the file whole


class Reader:
    """Random access: any run of ids through the block offsets, read in whole blocks."""

    def __init__(self, url: str):
        self.fs, path = open_fs(url)
        self.file = self.fs.open_input_file(path)
        size = self.file.size()
        head, foot = self.file.read_at(16, 0), self.file.read_at(32, size - 32)
        if head[:8] != MAGIC or foot[24:] != MAGIC:
            raise ValueError(f"{url} is not a token file")
        self.bits, self.block = struct.unpack("<II", head[8:])
        docs, blocks, self.total = struct.unpack("<QQQ", foot[:24])
        raw = self.file.read_at(16 * docs + 8 * blocks, size - 32 - 16 * docs - 8 * blocks)
        self.ids = np.frombuffer(raw, "<i8", docs)
        self.lengths = np.frombuffer(raw, "<u8", docs, 8 * docs).astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.offsets = np.frombuffer(raw, "<u8", blocks, 16 * docs).astype(np.int64)
        self.end = size - 32 - 16 * docs - 8 * blocks

    def read(self, start: int, count: int) -> np.ndarray:
        """Ids ``start .. start + count - 1`` of the file."""
        if count <= 0:
            return np.empty(0, np.uint32)
        first, last = start // self.block, (start + count - 1) // self.block
        stop = int(self.offsets[last + 1]) if last + 1 < len(self.offsets) else self.end
        raw = self.file.read_at(stop - int(self.offsets[first]), int(self.offsets[first]))
        held = min(self.total, (last + 1) * self.block) - first * self.block
        return unpack(raw, held, self.bits)[start - first * self.block :][:count]

    def document(self, k: int) -> np.ndarray:
        return self.read(int(self.starts[k]), int(self.lengths[k]))


def write(
    docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0, file_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text",
    special: bool = False,
) -> DataFrame:
    """Encode every text, write the files and return their manifest ``(file, start, n_docs, n_tokens)``.

    Files hold ranges of ascending ids, about ``file_rows`` documents each (more
    if that made over ``MAX_FILES`` files), and ``start`` counts the ids of the files before. Ranges are cut at quantiles of
    the id column alone, so that texts are encoded once and only packed ids are
    shuffled. Rows that repeat an id stay together, ordered by their ids'
    checksum; their file grows with them. Null ids come first (stored as the
    least long). A null text has the end id only. An empty table has no files.
    ``special``: special tokens in a text are one id, as in the plain tokenizer.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    n = rows.count()
    count = min(max(1, -(-n // file_rows)), MAX_FILES)
    cuts = rows.agg(F.percentile_approx("doc_id", [k / count for k in range(1, count)], 10 * MAX_FILES).alias("c")).first()["c"] if count > 1 else []
    cuts = sorted(set(cuts or []))
    from tokenizers import Tokenizer

    with open(tokenizer, encoding="utf-8") as file:
        description = file.read()  # a vocabulary's size, whatever the corpus
    vocabulary = Tokenizer.from_str(description).get_vocab_size()
    held = docs.sparkSession.sparkContext.broadcast(description)
    bits = width_of(max(vocabulary, end_id + 1))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, stop = piece_encoder(held.value, special), np.array([end_id], np.uint32)
        bounds = np.array(cuts, np.int64)
        for part in by_bytes(batches, 1):
            who = part.column(0).to_numpy(zero_copy_only=False)
            made = [np.concatenate([x, stop]) for x in known.encode(part.column(1))]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.searchsorted(bounds, who, "right").astype(np.int32)), part.column(0),
                    pa.array([len(x) for x in made], pa.int64()), pa.array([zlib.crc32(x) for x in made], pa.int64()),
                    pa.array([pack(x, bits) for x in made], pa.binary()),
                ],
                names=["file_no", "doc_id", "n", "crc", "packed"],
            )

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, made = None, None, []

        def end():
            out.close()
            made.append((now, url, len(out.ids), out.total))

        for part in slices(batches, 64):
            for no, doc, n, _, raw in zip(*(part.column(i).to_pylist() for i in range(5))):
                if no != now:
                    if out is not None:
                        end()
                    now, url = no, f"{folder}/tokens-{no:08d}.bin"
                    out = Writer(url, bits)
                out.add(doc, unpack(raw, n, bits))
        if out is not None:
            end()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made)], names=["file_no", "file", "n_docs", "n_tokens"])

    fs, path = open_fs(folder)
    fs.create_dir(path, recursive=True)
    packed = rows.mapInArrow(encode, "file_no int, doc_id long, n long, crc long, packed binary")
    # One task for each file; by number, so that no two files meet in a task while others are idle.
    spans = packed.repartitionById(len(cuts) + 1, F.col("file_no")).sortWithinPartitions("file_no", "doc_id", "crc")
    files = materialise(spans.mapInArrow(save, "file_no long, file string, n_docs long, n_tokens long"))
    # One row a file: the window below orders files, not documents.
    before = F.sum("n_tokens").over(W.orderBy("file_no").rowsBetween(W.unboundedPreceding, -1))
    return files.select("file", F.coalesce(before, F.lit(0)).alias("start"), "n_docs", "n_tokens")


def read(manifest: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, from the files alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for url, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                file = Reader(url)
                for lo in range(0, len(file.ids), 4096):
                    hi = min(lo + 4096, len(file.ids))
                    crc = [zlib.crc32(file.document(k).astype("<u4")) for k in range(lo, hi)]
                    who = file.ids[lo:hi]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(who, mask=who == -(2**63)), pa.array(file.starts[lo:hi] + start),
                            pa.array(file.lengths[lo:hi]), pa.array(crc, pa.int64()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    # Dealt out by file, so that tasks share the reading; a few bytes a row.
    numbered = manifest.select("file", "start", F.expr("cast(regexp_extract(file, '([0-9]+)[.]bin$', 1) as int)").alias("no"))
    dealt = numbered.repartitionById(max(1, manifest.count()), F.col("no")).select("file", "start")
    return dealt.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def new_folder(spark) -> str:
    """A fresh folder in the cluster's shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
