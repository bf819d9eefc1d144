"""A set of artifacts that is written in one pass and committed together.

Each row goes, as JSON, to every artifact whose condition it meets; one job writes them all,
a folder an artifact, and counts what goes where as it does.  A manifest that names the
folder and its counts is written last and moved into place: readers go by the manifest, so
they see the set before or the set after, never parts of both, and a write that fails leaves
what was there.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: What an artifact is of: the rows for which the first holds, as the struct of the second.
Artifact = tuple[Column, Column]


class ArtifactSet:
    """The artifacts below ``folder``, which the driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _files(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return path(self.folder).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def manifest(self) -> dict | None:
        """folder and counts of the set that is in place."""
        files, path = self._files()
        at = path(f"{self.folder}/manifest.json")
        if not files.exists(at):
            return None
        return json.loads(self.spark.read.text(f"{self.folder}/manifest.json", wholetext=True).first().value)

    def publish(self, rows: DataFrame, artifacts: dict[str, Artifact], parts: list[str] | None = None) -> dict:
        """Writes the artifacts of ``rows``, below them by the columns ``parts`` (such as the
        task), and puts them in place of those before.  Returns the manifest."""
        parts = parts or []
        name = f"set-{uuid.uuid4().hex}"
        own = [F.when(c, F.struct(F.lit(n).alias("artifact"), F.to_json(v).alias("value"))) for n, (c, v) in artifacts.items()]
        out = rows.select(*parts, F.explode(F.array_compact(F.array(*own))).alias("_a")).select(*parts, "_a.artifact", "_a.value")
        seen = Observation(name)
        counted = out.observe(seen, F.count(F.lit(1)).alias("_all"), *[F.count_if(F.col("artifact") == n).alias(n) for n in artifacts])
        counted.write.partitionBy("artifact", *parts).text(f"{self.folder}/{name}")
        counts = {n: int(seen.get[n] or 0) for n in artifacts}
        found = {"folder": name, "counts": counts, "parts": parts}
        self._put("manifest.json", json.dumps(found, ensure_ascii=False))
        return found

    def _put(self, name: str, text: str) -> None:
        files, path = self._files()
        apart, at = path(f"{self.folder}/{name}.{uuid.uuid4().hex}"), path(f"{self.folder}/{name}")
        out = files.create(apart)
        out.write(bytearray(text.encode()))
        out.close()
        options = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        kinds = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        kinds[0] = options
        context.rename(apart, at, kinds)

    def read(self, artifact: str, schema: str) -> DataFrame:
        """The rows of an artifact of the set in place."""
        now = self.manifest()
        if not now or not now["counts"].get(artifact):
            return self.spark.createDataFrame([], schema)
        at = f"{self.folder}/{now['folder']}"
        return self.spark.read.option("basePath", f"{at}/artifact={artifact}").schema(schema).json(f"{at}/artifact={artifact}")

