"""A stop log of versions that share the files of untouched months.

Below ``root`` lie immutable month folders, ``data/v=<write>/month=<yyyy-MM>``, and one small text file a version,
``versions/<number>``, which names the folder of each month. A commit writes the months it touches to
a new ``v=`` folder and then puts the version's file in place by a rename that fails if the number is taken: whoever
reads sees the version before or after, whole. What a writer that died has left is named by no version. A version
carries the name of the stream and the number of the batch that made it, so a batch that comes again is known. All but the last ``keep``
versions expire with each commit, and with them the folders that only they name. The driver handles one line a
month, never rows."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another writer has committed the version."""


@dataclass
class Version:
    number: int
    schema: str
    months: dict[str, str] = field(default_factory=dict)  # month: name of its ``v=`` folder
    stream: str | None = None
    batch: int | None = None


class Files:
    """The few file operations that are needed, on whatever file system ``root`` names."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.gateway = spark._jvm, spark.sparkContext._gateway
        self.root = root.rstrip("/")
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self.path("").getFileSystem(self.conf)

    def path(self, below: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{below}" if below else self.root)

    def names(self, below: str) -> list[str]:
        at = self.path(below)
        return [x.getPath().getName() for x in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def read(self, below: str) -> str:
        stream = self.fs.open(self.path(below))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, below: str, text: str) -> None:
        """Write aside, then rename to a name that must be free."""
        aside = self.path(f"aside-{uuid.uuid4().hex}")
        stream = self.fs.create(aside, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        self.fs.mkdirs(self.path(below).getParent())
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        no_options = self.gateway.new_array(getattr(self.jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(aside, self.path(below), no_options)
        except Exception as e:
            self.fs.delete(aside, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(below) from e
            raise

    def drop(self, below: str) -> None:
        self.fs.delete(self.path(below), True)


def _name(number: int) -> str:
    return f"versions/{number:012d}"


def versions(spark: SparkSession, root: str) -> list[Version]:
    """All versions that have not expired, oldest first."""
    files = Files(spark, root)
    return [Version(**json.loads(files.read(f"versions/{n}"))) for n in sorted(files.names("versions")) if n.isdigit()]


def read_log(spark: SparkSession, root: str, month: str | None = None, year: int | None = None, version: int | None = None) -> DataFrame:
    """The rows of a version (the newest), or of its month or year; other months' files are not named."""
    known = [v for v in versions(spark, root) if version is None or v.number == version]
    if not known:
        raise ValueError(f"no such version below {root}")
    return _rows(spark, root, known[-1], lambda m: (month is None or m == month) and (year is None or m.startswith(f"{year:04d}-")))


def _rows(spark: SparkSession, root: str, version: Version, wanted) -> DataFrame:
    schema = StructType.fromJson(json.loads(version.schema))
    data = f"{root.rstrip('/')}/data"
    paths = [f"{data}/v={v}/month={m}" for m, v in sorted(version.months.items()) if wanted(m)]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", data).parquet(*paths).select(*schema.names)


def commit(df: DataFrame, root: str, dates: DataFrame | None = None, stream: str | None = None, batch: int | None = None, keep: int = 3) -> Version:
    """A new version in which ``df`` replaces all rows of ``dates``, also of those that now have none (without ``dates``:
    everything). Rows need a date. Only months of ``dates`` and of ``df`` are read and written."""
    spark, files, known = df.sparkSession, Files(df.sparkSession, root), versions(df.sparkSession, root)
    old = known[-1] if known else None
    for v in known:
        if stream is not None and v.stream == stream and v.batch >= batch:  # it has been committed before
            return v
    month = F.date_format("date", "yyyy-MM")
    rows, kept = df.where("date is not null"), {}
    if dates is not None and old is not None:
        days = dates.select(F.col("date").alias("__d")).where("__d is not null").distinct()
        touched = {r.m for r in days.select(F.date_format("__d", "yyyy-MM").alias("m")).union(rows.select(month)).distinct().collect()}
        before = _rows(spark, root, old, lambda m: m in touched)
        rows = before.join(days, F.col("date") == F.col("__d"), "left_anti").unionByName(rows, allowMissingColumns=True)
        kept = {m: v for m, v in old.months.items() if m not in touched}
    write = uuid.uuid4().hex
    rows.withColumn("month", month).hint("rebalance", "month").write.partitionBy("month").parquet(f"{files.root}/data/v={write}")
    made = {n.removeprefix("month="): write for n in files.names(f"data/v={write}") if n.startswith("month=")}
    version = Version(old.number + 1 if old else 0, rows.schema.json(), kept | made, stream, batch)
    try:
        files.put(_name(version.number), json.dumps(version.__dict__))
    except Conflict:
        files.drop(f"data/v={write}")
        raise
    expire(files, [*known, version], keep)
    return version


def expire(files: Files, known: list[Version], keep: int) -> None:
    """Drop all but the last ``keep`` versions and the month folders that no other names."""
    gone, left = known[:-keep], known[-keep:]
    used = {x for v in left for x in v.months.items()}
    for v in gone:
        files.drop(_name(v.number))
    for m, write in {x for v in gone for x in v.months.items()} - used:
        files.drop(f"data/v={write}/month={m}")
