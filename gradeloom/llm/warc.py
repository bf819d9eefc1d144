"""WARC archives with a two-level capture index.

Records are gzip members of their own, so one can be read by its byte range alone.  Of the
captures with equal payloads of at least ``REVISIT`` bytes the one with the largest page_id
is a response record; the others are revisit records that name it.  The index has a line a
capture, sorted by reversed-host URL key, in compressed blocks of ``LINES`` lines; a sparse
directory has each block's first key and place.  A look-up binary-searches the directory,
reads the blocks that may have its key, and then the records' ranges.

Cases: a null html is an empty payload; a null url has the key ``-``; a null page_id is the
least.  Rows repeated whole are captures each: one response (or, below the size, each of
them), the others revisit it.  No rows: no archives.  Urls are percent-encoded in headers.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import pickle
import re
import zlib
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.llm.shared import NewFile, batch, exists, file_system, read_range, shared_dir, write_file, written

REVISIT = 1000
#: Captures of an index block, as long as there are no more than so many blocks.
LINES, MOST_BLOCKS = 3000, 100_000
#: Captures of an index shard, about.
SHARD_ROWS = 30_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: str | None) -> str:
    """Reversed host, then path and query: ``com,example)/a?b``, without scheme, port and fragment."""
    if url is None:
        return "-"
    try:
        parts = urlsplit(url.strip())
        host = parts.hostname or ""
    except ValueError:
        return quote(url, safe="")
    host = ",".join(reversed(host.removeprefix("www.").split("."))) if host else ""
    return quote(f"{host}){parts.path or '/'}{'?' + parts.query if parts.query else ''}", safe="!#$&'()*+,/:;=?@[]~%-._")


def gz(data: bytes) -> bytes:
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def record_id(page_id: int | None, row: int) -> str:
    return f"<urn:gradeloom:page:{'null' if page_id is None else page_id}:{row}>"


def page_of(name: str) -> int | None:
    page = name.rstrip(">").split(":")[3]
    return None if page == "null" else int(page)


def header_url(url: str) -> str:
    return quote(url, safe="!#$&'()*+,/:;=?@[]~%-._")


def record(page_id, row, url, digest: str, size: int, payload: bytes | None, refers: dict | None) -> bytes:
    """A response record, or a revisit record from its payload's digest and size alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers else 'response'}", f"WARC-Record-ID: {record_id(page_id, row)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {header_url(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}")
    if refers:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers['page_id'], refers['row'])}", f"WARC-Refers-To-Date: {DATE}"]
        if refers["url"] is not None:
            head.append(f"WARC-Refers-To-Target-URI: {header_url(refers['url'])}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers, HTTP header and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines)}
    block, end = rest[: int(headers["content-length"])], rest[int(headers["content-length"]) :]
    if end != b"\r\n\r\n":
        raise ValueError("a record is not as long as its header says")
    http, _, payload = block.partition(b"\r\n\r\n")
    return headers, http, payload


CAPTURES = "key string, page_id long, row long, file string, begin long, length long"
CAPTURE = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("row", pa.int64()), ("file", pa.string()), ("begin", pa.int64()), ("length", pa.int64())])


def write_archives(pages: DataFrame, path: str) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) to archives; returns the captures."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = written(
        pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"), F.monotonically_increasing_id().alias("row"))
        .withColumns({"size": F.octet_length("payload"), "digest": F.sha1("payload")})
    )
    write_references(rows, path)

    def run(batches):
        file = f"{path}/archive-{TaskContext.get().partitionId():06d}.warc.gz"
        out, at, known = None, 0, (-1, {})
        for b in batches:
            columns: list[list] = [[] for _ in CAPTURE]
            for page_id, row, url, data, digest, size in zip(*(b.column(c).to_pylist() for c in ("page_id", "row", "url", "payload", "digest", "size")), strict=True):
                if out is None:
                    out = NewFile(file)
                if known[0] != row >> PART_BITS:
                    known = row >> PART_BITS, references(path, row >> PART_BITS)
                refers = known[1].get(row)
                member = gz(record(page_id, row, url, digest, size, None if refers else data, refers))
                out.write(member)
                for column, x in zip(columns, (url_key(url), page_id, row, file, at, len(member)), strict=True):
                    column.append(x)
                at += len(member)
            yield batch(CAPTURE, columns)
        if out is not None:
            out.close()

    return written(rows.mapInArrow(run, CAPTURES))


#: The lower bits of a row's number count the rows of the input's part; the others name the part.
PART_BITS = 33
#: A payload that more than one in so many rows has is common.
COMMON = 1000


def write_references(rows: DataFrame, path: str) -> None:
    """For each part of the input a file that says which of its rows revisit what.  Digests and
    numbers travel, payloads don't.  Common payloads, ``COMMON`` at most, are known everywhere
    instead of being dealt out."""
    large = rows.where(F.col("size") >= REVISIT).select("page_id", "url", "row", "digest", "size")
    # a null page_id is less than any other: structs compare null first
    groups = large.groupBy("digest", "size").agg(F.max(F.struct("page_id", F.negative("row").alias("last"), "url")).alias("kept"), F.count(F.lit(1)).alias("n"))
    groups = written(groups.where(F.col("n") > 1))
    most = max(COMMON, (groups.agg(F.sum("n")).first()[0] or 0) // COMMON)
    common = F.broadcast(groups.where(F.col("n") > most).drop("n"))
    key = ["digest", "size"]
    rare = large.join(common.select(*key), key, "left_anti").join(groups.where(F.col("n") <= most).drop("n"), key)
    found = large.join(common, key).unionByName(rare).where(F.negative("row") != F.col("kept.last"))
    found = found.select(F.shiftright("row", PART_BITS).alias("part"), "row", F.col("kept.page_id").alias("page_id"), F.negative("kept.last").alias("kept"), F.col("kept.url").alias("url"))
    schema = pa.schema([("part", pa.int64())])

    def run(batches):
        at, own = None, {}

        def close() -> None:
            write_file(f"{path}/refers-{at}", zlib.compress(pickle.dumps(own), 1))

        for b in batches:
            for part, row, page_id, kept, url in zip(*(b.column(c).to_pylist() for c in ("part", "row", "page_id", "kept", "url")), strict=True):
                if part != at:
                    if own:
                        close()
                    at, own = part, {}
                own[row] = {"page_id": page_id, "row": kept, "url": url}
        if own:
            close()
        yield batch(schema, [[]])

    found.repartition("part").sortWithinPartitions("part").mapInArrow(run, "part long").count()


def references(path: str, part: int) -> dict[int, dict]:
    """What the rows of a part revisit, by row."""
    files, name = file_system(f"{path}/refers-{part}")
    if not exists(files, name):
        return {}
    with files.open_input_file(name) as f:
        return pickle.loads(zlib.decompress(f.read()))  # it lives between two jobs of one call


def write_index(captures: DataFrame, path: str) -> list[tuple[str, str, int, int]]:
    """Writes the capture index's shards; returns its sparse directory, sorted: first key,
    file, begin, length of each block (``MOST_BLOCKS`` rows and one a shard at most)."""
    n = captures.count()
    most = max(LINES, -(-n // MOST_BLOCKS))
    schema = pa.schema([("shard", pa.int32()), ("number", pa.int32()), ("first", pa.string()), ("file", pa.string()), ("begin", pa.int64()), ("length", pa.int64())])

    def run(batches):
        shard = TaskContext.get().partitionId()
        file = f"{path}/index-{shard:06d}.cdxj.z"
        blocks: list[bytes] = []
        found: list[list] = [[] for _ in schema]
        lines: list[str] = []
        first, at = "", 0

        def close() -> None:
            nonlocal at, lines
            data = zlib.compress("\n".join(lines).encode(), 6)
            for column, x in zip(found, (shard, len(blocks), first, file, at, len(data)), strict=True):
                column.append(x)
            blocks.append(data)
            at += len(data)
            lines = []

        for b in batches:
            for key, page_id, row, archive, begin, length in zip(*(b.column(c).to_pylist() for c in CAPTURE.names), strict=True):
                if not lines:
                    first = key
                lines.append(f"{key} {json.dumps([page_id, row, archive, begin, length], separators=(',', ':'))}")
                if len(lines) == most:
                    close()
        if lines:
            close()
        if blocks:
            write_file(file, b"".join(blocks))
            yield batch(schema, found)

    order = [F.col(c).asc_nulls_first() for c in ("key", "page_id", "row")]
    placed = captures.repartitionByRange(max(1, -(-n // max(SHARD_ROWS, 10 * most))), *order).sortWithinPartitions(*order)
    rows = placed.mapInArrow(run, "shard int, number int, first string, file string, begin long, length long").collect()
    rows.sort(key=lambda r: (r["shard"], r["number"]))
    return [(r["first"], r["file"], r["begin"], r["length"]) for r in rows]


def blocks_of(firsts: list[str], key: str) -> range:
    """By binary search, the blocks that may have a key: it may begin in the block before the
    first one that starts with it."""
    return range(max(0, bisect.bisect_left(firsts, key) - 1), bisect.bisect_right(firsts, key))


def look_up(spark: SparkSession, directory: list[tuple[str, str, int, int]], keys: DataFrame) -> DataFrame:
    """All captures of the given keys (column key), as the archives have them: page_id,
    payload_bytes, payload_digest, record_type, refers_to, key and payload."""
    firsts = spark.sparkContext.broadcast([d[0] for d in directory])  # MOST_BLOCKS keys and one a shard at most

    def search(batches):
        own = firsts.value
        for b in batches:
            pairs = [(n, k) for k in b.column("key").to_pylist() for n in blocks_of(own, k)]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in pairs], pa.int64()), pa.array([k for _, k in pairs], pa.string())], names=["block", "key"])

    def lines(batches):
        """The captures in blocks that have the keys wanted of them; rows come sorted by block."""
        at, place, wanted = None, None, set()

        def found():
            files, path = file_system(place[0])
            text = zlib.decompress(read_range(files, path, *place[1:])).decode()
            got = [line.partition(" ") for line in text.split("\n")]
            own = [(x[0], *json.loads(x[2])) for x in got if x[0] in wanted]
            return batch(CAPTURE, [[o[k] for o in own] for k in range(len(CAPTURE))])

        for b in batches:
            for block, key, *where in zip(*(b.column(c).to_pylist() for c in ("block", "key", "file", "begin", "length")), strict=True):
                if block != at:
                    if wanted:
                        yield found()
                    at, place, wanted = block, where, set()
                wanted.add(key)
        if wanted:
            yield found()

    wanted = keys.select("key").distinct().mapInArrow(search, "block long, key string")
    places = spark.createDataFrame([(k, *d[1:]) for k, d in enumerate(directory)], "block long, file string, begin long, length long")
    found = wanted.join(F.broadcast(places), "block").repartition("block").sortWithinPartitions("block").mapInArrow(lines, CAPTURES)
    # one archive's records together, in the order they lie
    found = found.repartition("file", F.floor(F.col("begin") / (8 << 20))).sortWithinPartitions("file", "begin")
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("key", pa.string()), ("payload", pa.binary())])

    def records(batches):
        opened, handle = "", None
        for b in batches:
            columns: list[list] = [[] for _ in schema]
            for key, file, begin, length in zip(*(b.column(c).to_pylist() for c in ("key", "file", "begin", "length")), strict=True):
                if file != opened:
                    if handle:
                        handle.close()
                    files, path = file_system(file)
                    opened, handle = file, files.open_input_file(path)
                handle.seek(begin)
                headers, http, payload = parse_record(zlib.decompress(handle.read(length), 31))
                said = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:")).hex()
                size = int(re.search(rb"(?i)content-length: (\d+)", http)[1])
                revisit = headers["warc-type"] == "revisit"
                if not revisit and (hashlib.sha1(payload).hexdigest() != said or len(payload) != size):
                    raise ValueError(f"{file} at {begin}: the payload is not the one that was written")
                row = (page_of(headers["warc-record-id"]), size, said, headers["warc-type"], page_of(headers["warc-refers-to"]) if revisit else None, key, None if revisit else payload)
                for column, x in zip(columns, row, strict=True):
                    column.append(x)
            yield batch(schema, columns)
        if handle:
            handle.close()

    return found.mapInArrow(records, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, key string, payload binary")


def keys_of(pages: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([url_key(u) for u in b.column("url").to_pylist()], pa.string())], names=["key"])

    return pages.select("url").mapInArrow(run, "key string")


def archive(pages: DataFrame) -> tuple[list[tuple[str, str, int, int]], DataFrame]:
    """Archives and index of ``pages`` in a shared folder: the directory and the captures."""
    path = shared_dir(pages.sparkSession)
    captures = write_archives(pages, path)
    return write_index(captures, path), captures
