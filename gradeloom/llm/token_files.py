"""Token files: frequency-ranked ids in byte-aligned variable-length coding.

``ranks.u32`` lists ids by falling frequency (ties: smaller id first); a token is coded as
its id's rank, so frequent tokens take one byte.  A shard file is a run of blocks, each

    6 little-endian uint64: magic, documents, tokens, control bytes, data bytes, 0
    int64 doc_id a document | uint8 whether it is null | uint64 tokens a document
    control bytes: 2 bits a token, four tokens a byte, lowest bits first: data bytes less 1
    data bytes: the ranks, little-endian

Decoding looks up each control byte in a table of 256 x 4 lengths and masks what an
unaligned 32-bit load finds at each token's place.  Shards are numbered, and documents lie
in them, in ascending doc_id order: null first, equal doc_ids by text hash.

Cases: a null or empty text is the end token alone.  No rows: no shard.  A document of any
length is one entry; blocks hold whole documents.
"""

from __future__ import annotations

import pickle
import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.llm.bpe import encoder
from gradeloom.llm.shared import NewFile, batch, exists, file_system, shared_dir, write_file

MAGIC = 0x314B545341524947
#: Bytes of text of a shard; tokens of a block at least (the last of a shard may be smaller).
SHARD = 24_000_000
BLOCK = 1_000_000

LENGTHS = (1 + (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3)).astype(np.uint8)
MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def pack_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of 32-bit values."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    length = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = length - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    each = ranks.view(np.uint8).reshape(-1, 4)
    return control.tobytes(), each[np.arange(4) < length[:, None]].tobytes()


def unpack_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    length = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    ends = np.cumsum(length, dtype=np.int64)
    padded = np.frombuffer(data + b"\0\0\0\0", np.uint8)
    loads = np.lib.stride_tricks.as_strided(padded[:4].view("<u4"), (len(data) + 1,), (1,))
    return loads[ends - length] & MASKS[length]


def block_bytes(doc_ids: list, sizes: list[int], tokens: np.ndarray, rank_of: np.ndarray) -> bytes:
    """A block of documents from their ids, one after another."""
    sizes = np.array(sizes, "<u8")
    control, data = pack_ranks(rank_of[tokens])
    head = struct.pack("<6Q", MAGIC, len(sizes), len(tokens), len(control), len(data), 0)
    known = np.array([d or 0 for d in doc_ids], "<i8").tobytes()
    null = bytes(d is None for d in doc_ids)
    return b"".join((head, known, null, sizes.tobytes(), control, data))


def totals(uri: str) -> tuple[int, int]:
    """Documents and tokens of a shard file, from its blocks' heads."""
    files, path = file_system(uri)
    docs = tokens = 0
    with files.open_input_file(path) as f:
        while head := f.read(48):
            _, d, t, n_control, n_data, _ = struct.unpack("<6Q", head)
            docs, tokens = docs + d, tokens + t
            f.seek(f.tell() + 17 * d + n_control + n_data)
    return docs, tokens


def read_blocks(uri: str, id_of: np.ndarray):
    """(doc_ids, token counts, ids) of each block of a shard file."""
    files, path = file_system(uri)
    with files.open_input_file(path) as f:
        while head := f.read(48):
            magic, docs, tokens, n_control, n_data, _ = struct.unpack("<6Q", head)
            if magic != MAGIC:
                raise ValueError(f"{uri} is not a token file")
            doc_ids = np.frombuffer(f.read(8 * docs), "<i8").tolist()
            doc_ids = [None if z else d for d, z in zip(doc_ids, f.read(docs), strict=True)]
            sizes = np.frombuffer(f.read(8 * docs), "<u8").astype(np.int64)
            yield doc_ids, sizes, id_of[unpack_ranks(f.read(n_control), f.read(n_data), tokens)]


def _draft(path: str, tokenizer: str, keeps_space: bool, end_id: int):
    """Encodes a shard's documents, in order, to blocks of plain ids, and counts the ids."""
    schema = pa.schema([("id", pa.int32()), ("n", pa.int64())])

    def run(batches):
        own, shard = encoder(tokenizer, keeps_space), TaskContext.get().partitionId()
        total = np.zeros(end_id + 1, np.int64)
        out, doc_ids, counts, ids, size = None, [], [], [], 0

        def close() -> None:
            nonlocal out, total, doc_ids, counts, ids, size
            out = out or NewFile(f"{path}/draft-{shard:08d}")
            plain = np.concatenate(ids)
            found = np.bincount(plain, minlength=len(total))
            found[: len(total)] += total
            total = found
            narrow = plain.astype("<u2") if plain.max() < 2**16 else plain
            head = pickle.dumps((doc_ids, counts, narrow.dtype.str))
            data = zstandard.ZstdCompressor(level=1).compress(narrow.tobytes())
            out.write(struct.pack("<2Q", len(head), len(data)) + head + data)
            doc_ids, counts, ids, size = [], [], [], 0

        for b in batches:
            names, at = b.column("doc_id").to_pylist(), 0
            for plain, ends in own.runs(b.column("text"), end_id):
                counts += np.diff(ends, prepend=0).tolist()
                doc_ids += names[at : at + len(ends)]
                at += len(ends)
                ids.append(plain)
                size += len(plain)
                if size >= BLOCK:
                    close()
        if ids:
            close()
        if out:
            out.close()
        k = np.flatnonzero(total)
        yield batch(schema, [k.tolist(), total[k].tolist()])

    return run


def _blocks(f):
    """The drafts' blocks.  They live between two stages of one job, so pickle will do."""
    while sizes := f.read(16):
        n_head, n_data = struct.unpack("<2Q", sizes)
        doc_ids, counts, kind = pickle.loads(f.read(n_head))
        yield doc_ids, counts, np.frombuffer(zstandard.ZstdDecompressor().decompress(f.read(n_data)), kind)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, keeps_space: bool, end_id: int) -> DataFrame:
    """Writes ``docs`` (doc_id, text) to token files under ``path``; a row for each shard:
    shard, file, documents, tokens.

    Texts are dealt by doc_id range and encoded once, to drafts; when all ids are counted, a
    second stage turns each draft into its shard file and removes it.  A task that is run
    again finds its draft, or the finished file.  The driver holds the vocabulary's counts.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // SHARD))
    placed = docs.repartitionByRange(shards, F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    placed = placed.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")
    counts = placed.mapInArrow(_draft(path, tokenizer, keeps_space, end_id), "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    counts = counts.toPandas().sort_values(["n", "id"], ascending=[False, True])
    id_of = counts["id"].to_numpy().astype("<u4")
    write_file(f"{path}/ranks.u32", id_of.tobytes())
    rank_of = np.zeros(int(id_of.max(initial=end_id)) + 1, "<u4")
    rank_of[id_of] = np.arange(len(id_of))
    ranks = spark.sparkContext.broadcast(rank_of)  # as long as the vocabulary
    schema = pa.schema([("shard", pa.int32()), ("file", pa.string()), ("documents", pa.int64()), ("tokens", pa.int64())])

    def run(batches):
        for b in batches:
            for shard in b.column("shard").to_pylist():
                file = f"{path}/shard-{shard:08d}.tok"
                files, draft = file_system(f"{path}/draft-{shard:08d}")
                if exists(files, draft) and not exists(files, file_system(file)[1]):
                    out = NewFile(file)
                    with files.open_input_file(draft) as f:
                        for doc_ids, sizes, plain in _blocks(f):
                            out.write(block_bytes(doc_ids, sizes, plain, ranks.value))
                    out.close()
                if exists(files, file_system(file)[1]):
                    if exists(files, draft):
                        files.delete_file(draft)
                    yield batch(schema, [[shard], [file], *([x] for x in totals(file))])

    listed = spark.range(shards).select(F.col("id").cast("int").alias("shard")).repartition(shards)
    return listed.mapInArrow(run, "shard int, file string, documents long, tokens long")


def read_tokens(spark: SparkSession, shards: list, path: str, digest: bool = False) -> DataFrame:
    """All documents of the shards, read from their files: doc_id, start, n_tokens and ids
    (little-endian unsigned 32-bit), or, as ids_crc32, those bytes' checksum.  start counts the
    tokens of all documents before."""
    shards = sorted(shards, key=lambda s: s["shard"])
    before, rows = 0, []
    for s in shards:
        rows.append((s["file"], before))
        before += s["tokens"]
    last = ("ids_crc32", pa.int64()) if digest else ("ids", pa.binary())
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), last])

    def run(batches):
        files, name = file_system(f"{path}/ranks.u32")
        with files.open_input_file(name) as f:
            id_of = np.frombuffer(f.read(), "<u4")
        for b in batches:
            for file, start in zip(b.column("file").to_pylist(), b.column("before").to_pylist(), strict=True):
                for doc_ids, sizes, ids in read_blocks(file, id_of):
                    ends = np.cumsum(sizes)
                    data = memoryview(ids.astype("<u4", copy=False)).cast("B")
                    own = [data[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                    own = [zlib.crc32(x) for x in own] if digest else [bytes(x) for x in own]
                    yield batch(schema, [doc_ids, (start + ends - sizes).tolist(), sizes.tolist(), own])
                    start += int(ends[-1])

    listed = spark.createDataFrame(rows, "file string, before long").repartition(max(1, len(rows)))
    return listed.mapInArrow(run, f"doc_id long, start long, n_tokens long, {'ids_crc32 long' if digest else 'ids binary'}")


def token_table(docs: DataFrame, tokenizer: str, keeps_space: bool = False, end_id: int = 1, digest: bool = False) -> DataFrame:
    """Writes token files in a shared folder and reads them back."""
    path = shared_dir(docs.sparkSession)
    shards = write_tokens(docs, path, tokenizer, keeps_space, end_id).collect()  # a row a shard
    return read_tokens(docs.sparkSession, shards, path, digest)


