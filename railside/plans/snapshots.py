"""Tables in versions: readers keep the version they began with, writers replace whole parts.

The rows of a part (a month, a day) of a version are files in one folder and never change. A version
is a manifest that lists a folder for each part; a new version shares the folders of the parts that
it leaves alone. A manifest becomes visible by one rename to its number, which fails if another
writer was first, so a version is there as a whole or not at all. Marks in the manifest say what
the version was made from.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Files:
    """The few file operations that Spark's readers lack, in whatever store a path names."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark.sparkContext._jvm, root.rstrip("/")
        self.fs = self.path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        """What a folder holds, sorted; nothing if it is not there."""
        at = self.path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def under(self, path: str) -> list:
        """The state of a file, or of all files below a folder."""
        found, left = [], self.fs.listFiles(self.jvm.org.apache.hadoop.fs.Path(path), True)
        while left.hasNext():
            found.append(left.next())
        return found

    def text(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> bool:
        """A new file, whole at once; False if there is one of this name."""
        whole, part = self.path(name), self.path(f"{name}.{uuid.uuid4().hex}")
        stream = self.fs.create(part, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        if not self.fs.exists(whole) and self.fs.rename(part, whole):
            return True
        self.fs.delete(part, False)
        return False

    def drop(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


def state_of(spark: SparkSession, paths: Iterable[str]) -> tuple[str, int]:
    """A name for what files, or all files below folders, are now: by path, length and time; and their bytes."""
    told, total = [], 0
    for path in paths:
        for status in Files(spark, path).under(path):
            told.append(f"{status.getPath()} {status.getLen()} {status.getModificationTime()}")
            total += status.getLen()
    return hashlib.sha256("\n".join(sorted(told)).encode()).hexdigest()[:16], total


@dataclass(frozen=True)
class Manifest:
    """One version: the folder of each part (by the part's folder name), the rows' schema, and marks."""

    version: int = 0
    parts: dict[str, str] = field(default_factory=dict)
    schema: str = ""
    marks: dict = field(default_factory=dict)


class Conflict(RuntimeError):
    """Another writer has published the version that this one was about to."""


class Snapshots:
    """The versions of one table, in parts by the values of one column.

    Part values are such as stand in a path as they are: days, months, whole numbers, plain words.
    """

    def __init__(self, spark: SparkSession, path: str, part: str):
        self.spark, self.path, self.part = spark, path.rstrip("/"), part
        self.files = Files(spark, self.path)

    def manifest(self, version: int | None = None) -> Manifest:
        """The newest version, or the one asked for; number 0, without rows, before the first."""
        numbers = [n for n in self.files.names("versions") if n.endswith(".json")]
        name = numbers[-1] if numbers and version is None else f"{version or 0:012d}.json"
        return Manifest(**json.loads(self.files.text(f"versions/{name}"))) if name in numbers else Manifest()

    def read(self, manifest: Manifest | None = None, parts: Iterable | None = None) -> DataFrame:
        """The rows of one version (the newest by default), or of some of its parts.

        The version is fixed when this is called. Filters on the part column prune folders.
        """
        now = manifest or self.manifest()
        if not now.schema:
            raise LookupError(f"no version at {self.path}")
        schema = StructType.fromJson(json.loads(now.schema))
        wanted = now.parts if parts is None else {self._folder(p) for p in parts} & now.parts.keys()
        if not wanted:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(*[f"{self.path}/data/{now.parts[p]}" for p in sorted(wanted)])
        return rows.select(*schema.names)

    def _folder(self, value) -> str:
        return f"{self.part}={'__HIVE_DEFAULT_PARTITION__' if value is None else value}"

    def replace(self, rows: DataFrame, parts: Iterable | None = None, marks: dict | None = None, base: Manifest | None = None) -> Manifest:
        """Publish a version in which ``parts`` (by default all) hold ``rows`` and nothing else.

        ``rows`` must lie in these parts; a part without rows goes. ``base`` is the version that
        the rows were made from: if another one was published since, Conflict is raised and
        nothing changes. An aborted write leaves files that no manifest names (see ``vacuum``).
        """
        base = base or self.manifest()
        given = set(base.parts) if parts is None else {self._folder(p) for p in parts}
        folder = f"v={base.version + 1}-{uuid.uuid4().hex[:12]}"
        # large parts are split over tasks, small ones share one
        rows.hint("rebalance", F.col(self.part)).write.partitionBy(self.part).parquet(f"{self.path}/data/{folder}")
        written = {n: f"{folder}/{n}" for n in self.files.names(f"data/{folder}") if n.startswith(f"{self.part}=")}
        if parts is not None and (stray := written.keys() - given):
            raise ValueError(f"rows outside the parts that are replaced: {sorted(stray)[:5]}")
        kept = {p: f for p, f in base.parts.items() if p not in given}
        schema = StructType([f for f in rows.schema if f.name != self.part] + [rows.schema[self.part]])
        new = Manifest(base.version + 1, kept | written, schema.json(), {**base.marks, **(marks or {})})
        if not self.files.publish(f"versions/{new.version:012d}.json", json.dumps(vars(new))):
            raise Conflict(f"version {new.version} of {self.path} is there already")
        return new

    def refresh(self, rows: DataFrame) -> tuple[Manifest, list]:
        """Bring the table to ``rows``; only parts whose rows are others than before are written again.

        Parts are compared by their number of rows and two sums over 64-bit hashes of the rows, which
        are kept as marks. Returns the version and the values of the parts that changed.
        """
        base = self.manifest()
        h = F.xxhash64(*sorted(rows.columns))
        by_part = rows.groupBy(F.col(self.part).cast("string").alias("part")).agg(F.count("*").alias("n"), F.sum(h.bitwiseAND(0x7FFFFFFF)).alias("low"), F.bit_xor(h).alias("all"))
        now = {r.part: [r.n, r.low, r["all"]] for r in by_part.collect()}  # a row a part
        before = {(None if p == "null" else p[1:]): v for p, v in base.marks.get("sums", {}).items()}
        changed = [p for p in now.keys() | before.keys() if now.get(p) != before.get(p)]
        if not changed:
            return base, []
        inside = F.col(self.part).cast("string")
        some = rows.where(inside.isin([p for p in changed if p is not None]) | (inside.isNull() if None in changed else F.lit(False)))
        sums = {"null" if p is None else f"={p}": v for p, v in now.items()}
        return self.replace(some, changed, {"sums": sums}, base), sorted(changed, key=str)

    def vacuum(self, keep: int = 2) -> int:
        """Drop folders that none of the newest ``keep`` versions names, and older manifests; the number of folders.

        Run it while no writer is at work: what it has not yet published would go too.
        """
        numbers = [n for n in self.files.names("versions") if n.endswith(".json")]
        manifests = [Manifest(**json.loads(self.files.text(f"versions/{n}"))) for n in numbers[-keep:]]
        named = {f.split("/")[0] for m in manifests for f in m.parts.values()}
        old = [f for f in self.files.names("data") if f not in named]
        for n in numbers[:-keep]:
            self.files.drop(f"versions/{n}")
        for f in old:
            self.files.drop(f"data/{f}")
        return len(old)
