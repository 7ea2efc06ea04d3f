"""Token ids as files of independent zstandard frames with a trailing seek table.

Layout of a shard (all numbers little-endian):

    data frames    zstandard frames; each holds the ids (uint32) of whole documents
    index frame    skippable: a zstandard frame with doc_id int64[n], null uint8[n],
                   n_tokens uint64[n], data frame number uint32[n]
    seek table     skippable: per data frame its compressed size, size and checksum
                   (low half of XXH64 of the ids), then the number of frames, a
                   descriptor byte and the magic number of seekable files

A reader takes the seek table and the index from the end of the file and then
decompresses only the frames of the documents it was asked for; a frame whose
checksum differs raises.

`write_tokens` sorts the documents by id over range partitions and writes one
shard per partition. Each task writes to a name of its own and renames it at its end, so
repeated and speculative tasks leave whole shards. Ids come from the tokenizers library;
texts are cut before spaces that follow a non-space character, which no
pre-token spans, and each distinct piece is encoded once while it is kept (about
`cache_pieces` at a time).

Null texts count as empty (an end id alone); null ids sort first; repeated ids all
are written, ordered by text; an empty table gives no documents.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import common

TOKENIZER = "byte_bpe_50k.json"

# Fixed values of the zstandard seekable format.
SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEKABLE_MAGIC, CHECKSUM_FLAG = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80

SPACE_RUN = re.compile(r"\s ")
BEFORE_SPACE = re.compile(r"(?<=\S)(?= )")

#: What the byte-level pre-tokeniser shows for each byte: printable Latin-1 as itself, the rest from U+0100 on.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
SHOWN = {b: chr(b) for b in PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in PRINTABLE)}


class PieceEncoder:
    """Ids of texts as bytes; distinct pieces are encoded once while they are kept.

    With a plain byte-level BPE file, texts are cut before spaces, then into pre-tokens,
    and the library's model encodes each pre-token; with any other file, whole texts are encoded.
    """

    def __init__(self, tokenizer_path: str, cache_pieces: int) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(self.tokenizer.to_str())
        before, model = spec["pre_tokenizer"] or {}, spec["model"]
        self.plain = not (spec["normalizer"] or spec["post_processor"] or model.get("dropout")) and (
            before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"] and model["type"] == "BPE"
        )
        self.special = [t["content"] for t in spec["added_tokens"]]
        if any(" " in t["content"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            self.plain = False
        self.model, self.cache_pieces = self.tokenizer.model, cache_pieces
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.pieces_known: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}

    @staticmethod
    def pieces(text: str) -> list[str]:
        if SPACE_RUN.search(text):
            return BEFORE_SPACE.split(text)
        first, *rest = text.split(" ")
        return [first, *[" " + x for x in rest]]

    def pre_token(self, token: str) -> bytes:
        if (ids := self.known.get(token)) is None:
            shown = token.encode().decode("latin-1").translate(SHOWN)
            ids = self.known[token] = np.array([t.id for t in self.model.tokenize(shown)], "<u4").tobytes()
        return ids

    def piece(self, piece: str) -> bytes:
        if piece[:1] == " " and piece[1:].isalpha():
            return self.pre_token(piece)
        if any(s in piece for s in self.special):
            return self.whole([piece])[0]
        return b"".join([self.pre_token(t) for t in self.pattern.findall(piece)])

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def __call__(self, texts: list[str]) -> list[bytes]:
        if not self.plain:
            return self.whole(texts)
        if len(self.pieces_known) > self.cache_pieces:
            self.pieces_known = {}
        if len(self.known) > self.cache_pieces:
            self.known = {}
        kept, out = self.pieces_known, []
        for text in texts:
            parts = []
            for p in self.pieces(text):
                if (ids := kept.get(p)) is None:
                    ids = kept[p] = self.piece(p)
                parts.append(ids)
            out.append(b"".join(parts))
        return out


@lru_cache(maxsize=2)
def encoder(tokenizer_path: str, cache_pieces: int) -> PieceEncoder:
    return PieceEncoder(tokenizer_path, cache_pieces)


class ShardWriter:
    def __init__(self, sink, frame_bytes: int, level: int) -> None:
        self.sink, self.frame_bytes, self.codec = sink, frame_bytes, zstandard.ZstdCompressor(level=level)
        self.docs: list[tuple[int, int, int, int]] = []
        self.frames: list[tuple[int, int, int]] = []
        self.waiting: list[bytes] = []
        self.size = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self.size and self.size + len(ids) > self.frame_bytes:
            self.end_frame()
        self.docs.append((doc_id or 0, doc_id is None, len(ids) // 4, len(self.frames)))
        self.waiting.append(ids)
        self.size += len(ids)

    def end_frame(self) -> None:
        data = b"".join(self.waiting)
        packed = self.codec.compress(data)
        self.sink.write(packed)
        self.frames.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        self.waiting, self.size = [], 0

    def finish(self) -> None:
        if self.waiting:
            self.end_frame()
        columns = list(zip(*self.docs, strict=True)) or [(), (), (), ()]
        index = b"".join(np.array(c, t).tobytes() for c, t in zip(columns, ("<i8", "u1", "<u8", "<u4"), strict=True))
        packed = self.codec.compress(struct.pack("<Q", len(self.docs)) + index)
        self.sink.write(struct.pack("<II", SKIPPABLE_INDEX, len(packed)) + packed)
        table = b"".join(struct.pack("<III", *f) for f in self.frames)
        self.sink.write(struct.pack("<II", SKIPPABLE_SEEK, len(table) + 9) + table + struct.pack("<IBI", len(self.frames), CHECKSUM_FLAG, SEEKABLE_MAGIC))


class ShardReader:
    """Random access to the documents of an open shard."""

    def __init__(self, source) -> None:
        self.source = source
        end = source.seek(0, os.SEEK_END)
        n, flag, magic = struct.unpack("<IBI", self.at(end - 9, 9))
        if magic != SEEKABLE_MAGIC or not flag & CHECKSUM_FLAG:
            raise ValueError("no seek table at the end of this file")
        table_at = end - 9 - 12 * n
        self.frames = np.frombuffer(self.at(table_at, 12 * n), "<u4").reshape(n, 3)
        self.offsets = np.concatenate([[0], np.cumsum(self.frames[:, 0].astype(np.int64))])
        index_at = int(self.offsets[-1])
        magic, size = struct.unpack("<II", self.at(index_at, 8))
        if magic != SKIPPABLE_INDEX:
            raise ValueError("no document index after the last frame")
        raw = zstandard.ZstdDecompressor().decompress(self.at(index_at + 8, size))
        (docs,), at = struct.unpack_from("<Q", raw), 8
        columns = []
        for t in ("<i8", "u1", "<u8", "<u4"):
            columns.append(np.frombuffer(raw, t, docs, at))
            at += columns[-1].nbytes
        self.doc_id, self.null, self.n_tokens, self.frame = columns
        first = np.concatenate([[0], np.cumsum(self.n_tokens.astype(np.int64))])
        frame_first = first[:-1][np.searchsorted(self.frame, self.frame)] if docs else first[:-1]
        self.start, self.within = first[:-1], first[:-1] - frame_first

    def at(self, offset: int, size: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(size)

    def frame_data(self, k: int) -> bytes:
        data = zstandard.ZstdDecompressor().decompress(self.at(int(self.offsets[k]), int(self.frames[k, 0])), max_output_size=int(self.frames[k, 1]))
        if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.frames[k, 2]:
            raise ValueError(f"checksum of frame {k} differs")
        return data

    def documents(self, wanted: np.ndarray | None = None) -> Iterator[tuple[int | None, int, int, bytes]]:
        """(doc_id, ids before it in the shard, n_tokens, ids) in order, of all documents or the places
        in `wanted`; frames without one are not decompressed."""
        held, data = -1, b""
        for i in range(len(self.doc_id)) if wanted is None else wanted:
            if self.frame[i] != held:
                held, data = int(self.frame[i]), self.frame_data(int(self.frame[i]))
            a, n = 4 * int(self.within[i]), int(self.n_tokens[i])
            yield None if self.null[i] else int(self.doc_id[i]), int(self.start[i]), n, data[a : a + 4 * n]


def opened(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def write_tokens(
    df: DataFrame,
    out_dir: str,
    doc_id: str = "doc_id",
    text: str = "text",
    tokenizer_path: str | None = None,
    end_id: int | None = 2,
    shards: int | None = None,
    frame_bytes: int = 1 << 18,
    level: int = 3,
    cache_pieces: int = 800_000,
) -> list[tuple[str, int, int]]:
    """Write df's texts below out_dir, a folder that all executors reach; returns
    (file, documents, tokens) of each shard in order of the ids."""
    spark = df.sparkSession
    tokenizer_path = tokenizer_path or public_tokenizers.path(TOKENIZER)
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tail = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encode = TaskContext.get().partitionId(), encoder(tokenizer_path, cache_pieces)
        fs, folder = opened(out_dir)
        fs.create_dir(folder, recursive=True)
        mine, final = f"{folder}/_{part:06d}-{uuid.uuid4().hex}", f"{folder}/tokens-{part:06d}.zst"
        with fs.open_output_stream(mine) as sink:
            writer = ShardWriter(sink, frame_bytes, level)
            for batch in batches:
                for i, ids in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text").to_pylist()), strict=True):
                    writer.add(i, ids + tail)
            writer.finish()
        if writer.docs:
            fs.move(mine, final)
            yield pa.RecordBatch.from_pylist([{"part": part, "file": final, "docs": len(writer.docs), "tokens": sum(d[2] for d in writer.docs)}], shard_schema)
        else:
            fs.delete_file(mine)

    shard_schema = pa.schema([("part", pa.int32()), ("file", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())])
    common.modest_batches(spark)
    found = rows.mapInArrow(run, "part int, file string, docs long, tokens long").collect()  # a row for each shard
    return [(r.file, r.docs, r.tokens) for r in sorted(found)]


def read_tokens(spark: SparkSession, out_dir: str, shards: list[tuple[str, int, int]], doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (bytes) of the documents, or of those in doc_ids."""
    listed, before = [], 0
    for file, _, tokens in shards:
        listed.append((file, before))
        before += tokens
    schema = "doc_id long, start long, n_tokens long, ids binary"
    if not listed:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = opened(out_dir)
        for batch in batches:
            for file, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
                with fs.open_input_file(file) as source:
                    reader, rows, size = ShardReader(source), [], 0
                    wanted = None if doc_ids is None else np.flatnonzero(np.isin(reader.doc_id, doc_ids) & (reader.null == 0))
                    for i, start, n, ids in reader.documents(wanted):
                        rows.append((i, base + start, n, ids))
                        size += len(ids)
                        if size > 1 << 24:
                            yield frame(rows)
                            rows, size = [], 0
                    yield frame(rows)

    arrow = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())]

    def frame(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, arrow, strict=True)], [n for n, _ in arrow])

    files = spark.createDataFrame(listed, "file string, base long").repartition(len(listed))
    return files.mapInArrow(run, schema)
