"""Tables that grow by batches: sorted runs, merged on read, compacted, each batch once.

A batch becomes a run, a folder of Parquet files that are sorted by its keys. A manifest
names the runs that count and the last batch among them; it is a small file that is
renamed into place, so a crash leaves the table as it was before or after. A batch that
comes again is not written twice. Beyond ``most`` runs all are merged into one, and the
runs that the manifest before it named go with the next merge, so readers of the
latest two states find their files.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


class RunTable:
    """Rows by key; of rows that share one, that of the latest batch counts."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: str, most: int = 8):
        self.spark, self.path, self.keys, self.most = spark, path.rstrip("/"), keys, most
        self.schema = schema + ", batch long"

    def _files(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def manifest(self) -> dict:
        """The runs that count, the last batch and the state's number."""
        files, at = self._files(f"{self.path}/manifest")
        names = [s.getPath().getName() for s in files.listStatus(at)] if files.exists(at) else []
        states = sorted(n for n in names if n.endswith(".json") and not n.startswith("."))
        if not states:
            return {"state": 0, "last": -1, "runs": [], "gone": []}
        row = self.spark.read.text(f"{self.path}/manifest/{states[-1]}", wholetext=True).first()
        return json.loads(row.value)

    def _commit(self, state: dict) -> None:
        files, target = self._files(f"{self.path}/manifest/{state['state']:012d}.json")
        draft = self._files(f"{self.path}/manifest/.{uuid.uuid4().hex}")[1]
        out = files.create(draft)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if not files.rename(draft, target):
            raise RuntimeError("another writer committed this table meanwhile")
        old = self._files(f"{self.path}/manifest/{state['state'] - 2:012d}.json")[1]
        files.delete(old, False)

    def _write(self, rows: DataFrame) -> str:
        run = f"runs/{uuid.uuid4().hex}"
        rows.repartition(*self.keys[:1]).sortWithinPartitions(*self.keys).write.parquet(f"{self.path}/{run}")
        return run

    def append(self, rows: DataFrame, number: int) -> bool:
        """Add batch ``number``; False, and nothing done, if it is in the table already."""
        now = self.manifest()
        if number <= now["last"]:
            return False
        columns = [c.split()[0] for c in self.schema.split(", ")[:-1]]
        run = self._write(rows.select(*columns).withColumn("batch", F.lit(number).cast("long")))
        self._commit({"state": now["state"] + 1, "last": number, "runs": [*now["runs"], run], "gone": now["gone"]})
        if len(now["runs"]) + 1 > self.most:
            self.compact()
        return True

    def compact(self) -> None:
        """Merge all runs into one; those merged before are deleted."""
        now = self.manifest()
        if len(now["runs"]) < 2:
            return
        merged = self._write(self.load())
        self._commit({"state": now["state"] + 1, "last": now["last"], "runs": [merged], "gone": now["runs"]})
        for run in now["gone"]:
            files, at = self._files(f"{self.path}/{run}")
            files.delete(at, True)

    def load(self) -> DataFrame:
        """The rows that count, with the batch that they came in."""
        runs = self.manifest()["runs"]
        if not runs:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{r}" for r in runs])
        values = [c.split()[0] for c in self.schema.split(", ") if c.split()[0] not in self.keys]
        last = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*values), "batch").alias("v"))
        return last.select(*self.keys, "v.*")


def track_table(spark: SparkSession, path: str, most: int = 8) -> RunTable:
    """Stored points of tracks."""
    return RunTable(spark, path, ["track", "seq"], "track long, seq long, t timestamp, lat double, lon double, label string", most)


def load_points(table: RunTable) -> DataFrame:
    """Stored points with their place in their track: by date, of equal dates in the order of their coming."""
    from trailmark.functions.geo import valid_position

    rows = table.load().where(valid_position("lat", "lon") & F.col("t").isNotNull())
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("track").orderBy("t", "batch", "seq")))


def keep_points(stream: DataFrame, table: RunTable, checkpoint: str):
    """A query that adds points to a stored track, late ones too; a batch that comes again changes nothing."""

    def add(batch: DataFrame, number: int) -> None:
        table.append(batch, number)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class PhotoQueue:
    """Photos that wait to be read, claimed once a run, with a flag that stops the reading.

    Events arrive in batches: ``add`` of a photo, ``start`` of a run, ``stop``. A round takes a batch: it adds the photos,
    then, unless stopped, claims those that wait or failed and were not claimed in this run, and reads them. Photos that
    are added while a run lasts are read by it. All is keyed by the batch's number: a round that is repeated after a
    crash claims the same photos, and a photo whose outcome is known is not read again.
    """

    def __init__(self, spark: SparkSession, folder: str, read: Callable[[DataFrame], DataFrame]):
        self.read = read
        self.photos = RunTable(spark, f"{folder}/photos", ["id"], "id string, t timestamp")
        self.control = RunTable(spark, f"{folder}/control", ["name"], "name string, run long, stopped boolean")
        self.claims = RunTable(spark, f"{folder}/claims", ["id", "run"], "id string, run long")
        self.outcomes = RunTable(spark, f"{folder}/outcomes", ["id"], "id string, st string")

    def states(self) -> DataFrame:
        """id, st of every photo: its last outcome, else ``wait``."""
        return self.photos.load().select("id", "t").join(self.outcomes.load().select("id", "st"), "id", "left").withColumn("st", F.coalesce("st", F.lit("wait")))

    def round(self, events: DataFrame, number: int) -> None:
        """Take one batch of events: seq, kind, id, t."""
        spark = events.sparkSession
        if number <= self.outcomes.manifest()["last"]:
            return
        added = events.where("kind = 'add'").groupBy("id").agg(F.min("t").alias("t"))
        self.photos.append(added.join(self.photos.load().select("id"), "id", "left_anti"), number)
        last = self.control.load().first()
        run, stopped = (last.run, last.stopped) if last else (1, False)
        if self.control.manifest()["last"] < number:
            signs = events.where("kind in ('start', 'stop')").agg(F.count_if(F.col("kind") == "start").alias("starts"), F.max_by("kind", "seq").alias("sign")).first()
            run, stopped = run + signs.starts, stopped if signs.sign is None else signs.sign == "stop"
            self.control.append(spark.createDataFrame([("run", run, stopped)], "name string, run long, stopped boolean"), number)
        if self.claims.manifest()["last"] < number:
            open_ = self.states().where("st in ('wait', 'fail')").select("id").withColumn("run", F.lit(run).cast("long"))
            claimed = open_.join(self.claims.load().select("id", "run"), ["id", "run"], "left_anti")
            self.claims.append(claimed.where(F.lit(not stopped)), number)
        mine = self.claims.load().where(F.col("batch") == number).select("id")
        self.outcomes.append(self.read(mine).select("id", "st"), number)

    def follow(self, events: DataFrame, checkpoint: str):
        """A query that takes a stream of events, a round a batch."""
        return events.writeStream.foreachBatch(self.round).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
