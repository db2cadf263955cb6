"""Continuous checking of a folder: new and changed documents, and the documents whose links point at them, are checked again."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators import tables
from ..operators.lint import lint
from ..sources.shared import written

DOCUMENT = "doc_id long, path string, kind string, code_lang string, text string, version long"


def latest(documents: DataFrame) -> DataFrame:
    """The last version of every path."""
    newest = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("version"), F.desc("doc_id")))
    return documents.withColumn("__n", newest).where("__n = 1").drop("__n")


def to_recheck(changed: DataFrame, links: DataFrame) -> DataFrame:
    """Paths to check again: those changed, those they pointed at before, and those that point at them."""
    paths = changed.select("path").distinct()
    pointing = links.join(paths.select(F.col("path").alias("target")), "target", "left_semi").select("path")
    before = links.join(paths, "path", "left_semi").where("target IS NOT NULL").select(F.col("target").alias("path"))
    return paths.union(pointing).union(before).distinct()


class State:
    """Documents, links and findings of a watched folder, kept in the shared folder so that a new driver goes on where the last one ended.

    Each table lies in ``parts`` parts by a hash of the path; a batch rewrites those parts that its paths are in. A manifest for each batch
    names the folder of every part: it appears when all its tables are there, so a batch that failed or comes again changes nothing.
    """

    TABLES = ("documents", "links", "findings")

    def __init__(self, spark: SparkSession, folder: str, rules: list[str] | None = None, config: dict | None = None, parts: int = 32):
        self.spark, self.folder, self.rules, self.config, self.parts = spark, folder.rstrip("/"), rules, config, parts
        self.done, self.where, self.schemas = -1, {name: {} for name in self.TABLES}, {}
        self._load()

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _system(self):
        return self._path("x").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _load(self) -> None:
        system, root = self._system(), self._path("manifests")
        if system.exists(root):
            numbers = sorted(int(m[1]) for s in system.listStatus(root) if (m := re.fullmatch(r"(\d+)\.json", s.getPath().getName())))
            if numbers:
                text = "\n".join(r["value"] for r in self.spark.read.text(f"{self.folder}/manifests/{numbers[-1]}.json").collect())
                own = json.loads(text)
                self.done, self.where = own["batch"], {name: {int(k): v for k, v in parts.items()} for name, parts in own["tables"].items()}
                self.schemas = {name: StructType.fromJson(schema) for name, schema in own["schemas"].items()}

    def _commit(self, number: int) -> None:
        """Write the manifest under another name and rename it: it is there whole or not at all."""
        text = json.dumps({"batch": number, "tables": self.where, "schemas": {name: schema.jsonValue() for name, schema in self.schemas.items()}})
        system, made, final = self._system(), self._path(f"manifests/{uuid.uuid4().hex}.tmp"), self._path(f"manifests/{number}.json")
        out = system.create(made)
        out.write(text.encode())
        out.close()
        system.rename(made, final)
        self.done = number

    @property
    def now(self) -> dict[str, DataFrame]:
        """The tables as the last batch left them."""
        return {name: self._read(name) for name in self.TABLES if name in self.schemas}

    def _read(self, name: str, parts: list[int] | None = None) -> DataFrame:
        paths = [p for k, p in self.where[name].items() if parts is None or k in parts]
        schema = self.schemas[name]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _part(self, path="path"):
        return F.pmod(F.xxhash64(path), F.lit(self.parts)).cast("int")

    def _put(self, name: str, df: DataFrame, parts: list[int]) -> None:
        """Replace parts of a table; a part without rows has no folder."""
        folder = f"{self.folder}/{name}-{uuid.uuid4().hex}"
        df.withColumn("part", self._part()).write.partitionBy("part").parquet(folder)
        self.schemas[name] = df.schema
        system, root = self._system(), self._path(folder.rsplit("/", 1)[1])
        there = {int(m[1]) for s in system.listStatus(root) if (m := re.fullmatch(r"part=(\d+)", s.getPath().getName()))}
        self.where[name] = {k: v for k, v in self.where[name].items() if k not in parts} | {k: f"{folder}/part={k}" for k in there}

    def _parts_of(self, paths: DataFrame) -> list[int]:
        return sorted(r["k"] for r in paths.select(self._part().alias("k")).distinct().collect())  # at most ``parts`` rows

    def batch(self, new: DataFrame, number: int) -> None:
        """One micro-batch; a batch that comes again after a failure changes nothing."""
        if number > self.done:
            self._check(written(latest(new), "watch-changed"), number)

    def _check(self, changed: DataFrame, number: int, everything: bool = False) -> None:
        known = "documents" in self.schemas
        parts = self._parts_of(changed)
        if known:
            old = self._read("documents", parts)
            self._put("documents", latest(old.unionByName(changed.select(*old.columns))), parts)
        else:
            self._put("documents", changed, parts)
        own = written(tables.links(changed).join(changed.select("doc_id", "path"), "doc_id").select("path", "target"), "watch-links")
        links = self._read("links") if known else None
        documents = self._read("documents")
        again = documents.select("path") if everything else to_recheck(changed, links.unionByName(own) if links is not None else own).join(documents.select("path"), "path", "left_semi")
        again = written(again, "watch-again", True)
        if known:
            kept = self._read("links", parts).join(changed.select("path"), "path", "left_anti")
            self._put("links", kept.unionByName(own), parts)
        else:
            self._put("links", own, parts)
        touched = self._parts_of(again)
        found = lint(self._read("documents", touched).join(again, "path", "left_semi"), self.rules, self.config, settle=True)
        if known:
            kept = self._read("findings", touched).join(again, "path", "left_anti")
            found = kept.unionByName(found.select(*kept.columns))
        self._put("findings", found, touched)
        self._commit(number)

    def reload(self, rules: list[str] | None = None, config: dict | None = None) -> None:
        """Other rules or options from now on: all documents are checked again."""
        self.rules, self.config = rules, config
        if "documents" in self.schemas:
            self._check(self._read("documents").limit(0), self.done, everything=True)


def watch(spark: SparkSession, folder: str, state: State, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Check Parquet files of documents as they arrive in ``folder``."""
    stream = spark.readStream.schema(DOCUMENT).parquet(folder)
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(state.batch)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()
