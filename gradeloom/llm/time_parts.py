"""Adaptive time partitions: a table's files follow its rows over time.

Each partition counts its rows in a nested trie, year to month to day to hour; ``treeReduce``
merges the tries, and a depth-first walk folds them to leaves of about ``limit`` rows: a node
above the limit splits into all its children, its children within the limit join in runs.
Rows descend the folded trie, which is broadcast, to their leaf.  A leaf's rows in order fill
parts of ``limit`` rows, a Parquet file each, which one task writes, streaming.  ``rewrite``
lays the table out anew and leaves each file whose leaf, part and rows recur.

What the driver and the broadcast hold is bounded apart from the input: a trie has at most as
many leaves as the calendar has hours between the first and last moment, and is merged in
tasks; folded leaves and files number a few thousands, as ``limit`` is a share of the rows.
No leaf is gathered: rows of a leaf above the limit are ordered by range partitioning, equal
rows apart, and numbered part by part.

Cases: rows without a moment make the leaf ``null``.  An order column's null comes first; ties
of all order columns lie in any order, and count as the same rows.  Repeated rows stay.  No
rows: no file.  Rows that recur are known by their number and two 64-bit hashes' sums.
Helper columns begin with ``_tp_``, so other columns' names don't matter.
"""

from __future__ import annotations

import hashlib
import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from gradeloom.llm.shared import NewFile, batch, file_system, shared_dir, tidy, written

#: Hashes of a row.
SEEDS = (0, 1)
#: Rows of a row group of a file.
GROUP = 100_000
#: The leaf of rows without a moment.
NULL = "null"


def hours(moment: Column) -> Column:
    """Hours since 1970 of a timestamp without a zone, whatever the session's zone is."""
    return F.datediff(moment.cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 24 + F.hour(moment)


def keys(hour: np.ndarray) -> tuple[np.ndarray, ...]:
    """Year, month, day and hour, each with all above it in one number, of hours since 1970."""
    day = hour // 24
    month = day.astype("datetime64[D]").astype("datetime64[M]").astype(np.int64)
    return month // 12, month, day, hour


def trie_of(hour: np.ndarray) -> dict:
    """Counts of hours, nested by year, month and day; None counts what has no hour."""
    out: dict = {}
    at, counts = np.unique(hour, return_counts=True)
    for year, month, day, h, n in zip(*(x.tolist() for x in keys(at)), counts.tolist(), strict=True):
        into = out.setdefault(year, {}).setdefault(month, {}).setdefault(day, {})
        into[h] = into.get(h, 0) + n
    return out


def merge(a: dict, b: dict) -> dict:
    """The trie of both tries' rows, in the place of the first."""
    for k, x in b.items():
        a[k] = merge(a[k], x) if isinstance(x, dict) and k in a else x if isinstance(x, dict) else a.get(k, 0) + x
    return a


def size(node) -> int:
    return sum(map(size, node.values())) if isinstance(node, dict) else node


def children(key: int, level: int) -> range:
    """All children of a node of a level: months of a year, days of a month, hours of a day."""
    if level == 0:
        return range(12 * key, 12 * key + 12)
    if level == 1:
        first, last = (np.array([key, key + 1]).astype("datetime64[M]").astype("datetime64[D]").astype(np.int64)).tolist()
        return range(first, last)
    return range(24 * key, 24 * key + 24)


def label(key: int, level: int) -> str:
    if level == 0:
        return f"{key + 1970:04d}"
    if level == 1:
        return f"{key % 12 + 1:02d}"
    return str(np.datetime64(key, "D"))[-2:] if level == 2 else f"{key % 24:02d}"


@dataclass
class Leaf:
    """A run of siblings: its name, level, first and last key, and rows."""

    name: str
    level: int
    first: int
    last: int
    rows: int


def fold(trie: dict, limit: int) -> list[Leaf]:
    """Leaves in time order, by a depth-first walk; ``trie`` may hold None: rows without a moment."""
    leaves: list[Leaf] = []
    null = trie.get(None, 0)
    years = [y for y in trie if y is not None]

    def walk(members: range, nodes: dict, level: int, above: str) -> None:
        run: Leaf | None = None

        def close() -> None:
            if run and run.rows:
                run.name = f"{above}{label(run.first, level)}-{label(run.last, level)}"
                leaves.append(run)

        for key in members:
            node = nodes.get(key, 0)
            n = size(node)
            if n > limit and level < 3:
                close()
                run = None
                walk(children(key, level), node, level + 1, f"{above}{label(key, level)}/")
            elif run and run.rows + n <= limit:
                run.last, run.rows = key, run.rows + n
            else:
                close()
                run = Leaf("", level, key, key, n)
        close()

    if years:
        walk(range(min(years), max(years) + 1), trie, 0, "")
    if null:
        leaves.append(Leaf(NULL, -1, 0, 0, null))
    return leaves


class Folded:
    """The folded trie as rows descend it: at each level, keys with their leaf."""

    def __init__(self, leaves: list[Leaf]):
        self.levels = []
        for level in range(4):
            own = [(k, i) for i, x in enumerate(leaves) if x.level == level for k in range(x.first, x.last + 1)]
            self.levels.append(np.array(sorted(own), np.int64).reshape(-1, 2))
        self.null = next((i for i, x in enumerate(leaves) if x.level < 0), -1)

    def descend(self, hour: np.ndarray) -> np.ndarray:
        """The leaf of each hour."""
        out, open_ = np.full(len(hour), -1, np.int64), np.arange(len(hour))
        for key, level in zip(keys(hour), self.levels, strict=True):
            if not len(level) or not len(open_):
                continue
            at = np.minimum(np.searchsorted(level[:, 0], key[open_]), len(level) - 1)
            hit = level[at, 0] == key[open_]
            out[open_[hit]] = level[at[hit], 1]
            open_ = open_[~hit]
        return out


def _tries(batches):
    total: dict = {}
    for b in batches:
        hour = b.column(0)
        merge(total, trie_of(hour.drop_null().to_numpy(zero_copy_only=False)))
        if hour.null_count:
            merge(total, {None: hour.null_count})
    yield batch(pa.schema([("trie", pa.binary())]), [[pickle.dumps(total)]])


def counted(df: DataFrame, moment: Column) -> dict:
    """The table's trie."""
    tries = df.select(hours(moment).alias("hour")).mapInArrow(tidy(_tries), "trie binary").rdd
    return tries.map(lambda r: pickle.loads(r.trie)).treeReduce(merge, depth=3) if tries.getNumPartitions() else {}


def _numbered(batches):
    """Adds the task and a row's number within task and leaf; rows come leaf by leaf."""
    task, last, n = TaskContext.get().partitionId(), None, 0
    for b in batches:
        leaf = b.column("_tp_leaf").to_numpy()
        if not len(leaf):
            continue
        starts = np.flatnonzero(np.diff(leaf, prepend=leaf[0] - 1))
        at = np.arange(len(leaf)) - np.repeat(starts, np.diff(starts, append=len(leaf)))
        if leaf[0] == last:
            at[: starts[1] if len(starts) > 1 else len(leaf)] += n
        last, n = leaf[-1], int(at[-1]) + 1
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(leaf), task, np.int32)), pa.array(at)], names=[*b.schema.names, "_tp_task", "_tp_at"])


class Layout:
    """A table's leaves and rows placed in them: columns _tp_leaf and _tp_part are added."""

    def __init__(self, df: DataFrame, moment: Column, order: list[str], limit: int, known: Column):
        self.spark, self.columns, self.limit, self.order = df.sparkSession, df.columns, limit, order
        self.leaves = fold(counted(df, moment), limit)
        self.moment, self.tasks = moment, int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        folded = self.spark.sparkContext.broadcast(Folded(self.leaves))

        @F.arrow_udf("long")
        def leaf(hour: pa.Array) -> pa.Array:
            out, null = np.full(len(hour), folded.value.null, np.int64), hour.is_null().to_numpy(zero_copy_only=False)
            out[~null] = folded.value.descend(hour.drop_null().to_numpy(zero_copy_only=False))
            return pa.array(out)

        rows = df.withColumns({"_tp_leaf": leaf(hours(moment)), "_tp_known": F.coalesce(known, F.lit(False))} | {f"_tp_h{s}": F.xxhash64(F.lit(s), *(df[c] for c in df.columns)) for s in SEEDS})
        large = [i for i, x in enumerate(self.leaves) if x.rows > limit]
        self.rows = rows.withColumn("_tp_part", F.lit(1).cast("long"))
        if large:
            self.rows = self.rows.where(~F.col("_tp_leaf").isin(large)).unionByName(self._parts(rows.where(F.col("_tp_leaf").isin(large))))

    def _parts(self, rows: DataFrame) -> DataFrame:
        """Part numbers of the rows of leaves above the limit."""
        by = ["_tp_leaf", self.moment, *self.order]
        # equal rows lie apart by a number that a repeated task draws again
        dealt = rows.withColumn("_tp_salt", F.rand(7)).repartitionByRange(self.tasks, *by, "_tp_h0", "_tp_salt").sortWithinPartitions(*by).drop("_tp_salt")
        schema = StructType([*dealt.schema, StructField("_tp_task", IntegerType()), StructField("_tp_at", LongType())])
        numbered = written(dealt.mapInArrow(tidy(_numbered), schema))
        held = numbered.groupBy("_tp_leaf", "_tp_task").agg(F.count(F.lit(1)).alias("n"))
        before = held.select("_tp_leaf", "_tp_task", (F.sum("n").over(Window.partitionBy("_tp_leaf").orderBy("_tp_task")) - F.col("n")).alias("_tp_before"))
        # a task has one run of consecutive leaves: there are fewer rows here than tasks and leaves
        placed = numbered.join(F.broadcast(before), ["_tp_leaf", "_tp_task"])
        part = F.floor((F.col("_tp_before") + F.col("_tp_at")) / F.lit(self.limit)) + 1
        return placed.withColumn("_tp_part", part.cast("long")).select(*rows.columns, "_tp_part")

    def files(self) -> DataFrame:
        """leaf, part, n_rows, n_new and the rows' digest of each file."""
        low, high = F.lit(2**32 - 1), 32
        sums = [f(F.col(f"_tp_h{s}")).alias(f"{n}{s}") for s in SEEDS for n, f in (("low", lambda c: F.sum(c.bitwiseAND(low))), ("high", lambda c: F.sum(F.shiftrightunsigned(c, high))))]
        found = self.rows.groupBy("_tp_leaf", "_tp_part").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(~F.col("_tp_known")).alias("n_new"), *sums)
        names = self.spark.createDataFrame([(i, x.name) for i, x in enumerate(self.leaves)], "_tp_leaf long, leaf string")
        digest = F.concat_ws(" ", *(f"{n}{s}" for s in SEEDS for n in ("low", "high")))
        return found.join(F.broadcast(names), "_tp_leaf").select("_tp_leaf", "leaf", F.col("_tp_part").alias("part"), "n_rows", "n_new", digest.alias("digest"))

    def write(self, folder: str, version: str, key: str, stay: DataFrame | None = None) -> DataFrame:
        """Writes the files, but those of ``stay`` (_tp_leaf and _tp_part); leaf, part, ids_sha256
        (of ``key``, in file order) and path of each file written."""
        rows = self.rows if stay is None else self.rows.join(F.broadcast(stay), ["_tp_leaf", "_tp_part"], "left_anti")
        # files in time order are dealt to tasks by the rows before them, so tasks have like shares
        starts, n = [], 0
        for i, x in enumerate(self.leaves):
            starts.append((i, n))
            n += x.rows
        start = F.broadcast(self.spark.createDataFrame(starts, "_tp_leaf long, _tp_start long"))
        task = F.floor((F.col("_tp_start") + (F.col("_tp_part") - 1) * self.limit) * self.tasks / max(n, 1)).cast("int")
        dealt = rows.join(start, "_tp_leaf").repartitionById(self.tasks, F.least(task, F.lit(self.tasks - 1)))
        ordered = dealt.sortWithinPartitions("_tp_leaf", "_tp_part", self.moment, *self.order).select("_tp_leaf", "_tp_part", *self.columns)
        names = [x.name for x in self.leaves]
        out = ordered.mapInArrow(tidy(_writer(folder, version, key, names)), "leaf string, part long, ids_sha256 string, path string")
        return written(out)


class _File:
    """A Parquet file that is written as batches come."""

    def __init__(self, uri: str, schema: pa.Schema, key: str):
        self.uri, self.key, self.sha, self.first = uri, key, hashlib.sha256(), True
        self.out, self.held = NewFile(uri), []
        self.to = pq.ParquetWriter(self.out.out, schema, compression="zstd")

    def write(self, rows: pa.RecordBatch) -> None:
        ids = ",".join("" if v is None else str(v) for v in rows.column(self.key).to_pylist())
        self.sha.update((ids if self.first else "," + ids).encode())
        self.first = False
        self.held.append(rows)
        if sum(r.num_rows for r in self.held) >= GROUP:
            self.flush()

    def flush(self) -> None:
        self.to.write_table(pa.Table.from_batches(self.held, self.to.schema))
        self.held = []

    def close(self) -> None:
        if self.held:
            self.flush()
        self.to.close()
        self.out.close()


def _writer(folder: str, version: str, key: str, names: list[str]):
    schema = pa.schema([("leaf", pa.string()), ("part", pa.int64()), ("ids_sha256", pa.string()), ("path", pa.string())])

    def run(batches):
        now, file = None, None
        for b in batches:
            leaf, part = b.column("_tp_leaf").to_numpy(), b.column("_tp_part").to_numpy()
            own = b.select([c for c in b.schema.names if not c.startswith("_tp_")])
            cuts = np.flatnonzero((np.diff(leaf) != 0) | (np.diff(part) != 0)) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(leaf)], strict=True):
                if s == e:
                    continue
                if (at := (int(leaf[s]), int(part[s]))) != now:
                    if file:
                        file.close()
                        yield batch(schema, [[names[now[0]]], [now[1]], [file.sha.hexdigest()], [file.uri]])
                    now = at
                    name = f"{names[at[0]].replace('/', '_')}.{at[1]:06d}.{version}.parquet"
                    file = _File(f"{folder}/{name}", own.schema, key)
                file.write(own.slice(s, e - s))
        if file:
            file.close()
            yield batch(schema, [[names[now[0]]], [now[1]], [file.sha.hexdigest()], [file.uri]])

    return run


def removed(folder: str, keep: list[str]) -> None:
    """What ends the rewriting: files of the folder that no longer belong go."""
    from pyarrow import fs

    files, path = file_system(folder)
    names = {k.rsplit("/", 1)[1] for k in keep}
    for info in files.get_file_info(fs.FileSelector(path, allow_not_found=True)):
        if info.type == fs.FileType.File and info.base_name not in names:
            files.delete_file(info.path)


RESULT = "leaf string, part long, n_rows long, n_new long, rewritten boolean, columns string, ids_sha256 string, path string"


def rewrite(df: DataFrame, moment: Column, order: list[str], limit: int, first: Column, key: str) -> DataFrame:
    """Writes the rows where ``first`` holds into a new folder, then lays all rows out in it: a
    row a final file.

    ``moment`` is a timestamp without a zone; ``order`` are the columns that order rows of equal
    moments; ``key`` is the column whose values are digested.  The files are left there.
    """
    spark: SparkSession = df.sparkSession
    folder = shared_dir(spark, keep=True)
    begin = F.coalesce(first, F.lit(False))
    old = Layout(df.where(begin), moment, order, limit, F.lit(True))
    before = written(old.write(folder, "first", key).join(old.files(), ["leaf", "part"]).drop("_tp_leaf"))
    new = Layout(df, moment, order, limit, begin)
    after = written(new.files())
    stays = after.join(F.broadcast(before.select("leaf", "part", "digest", "n_rows", "ids_sha256", "path")), ["leaf", "part", "digest", "n_rows"])
    now = new.write(folder, "second", key, stays.select("_tp_leaf", F.col("part").alias("_tp_part")))
    wrote = after.join(F.broadcast(now), ["leaf", "part"]).withColumn("rewritten", F.lit(True))
    cols = ["leaf", "part", "n_rows", "n_new", "rewritten", F.lit(",".join(df.columns)).alias("columns"), "ids_sha256", "path"]
    out = written(wrote.select(*cols).unionByName(stays.withColumn("rewritten", F.lit(False)).select(*cols)))
    removed(folder, [r.path for r in out.select("path").collect()])
    return out
