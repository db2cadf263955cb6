"""Files to documents: discovery with ignore rules, kinds, and a strict configuration."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, fields

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.engine import with_kind, written_by_hand


def read_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, text) of the files under a folder that are valid UTF-8; ``path`` is relative to it."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    base = re.escape(re.sub(r"^[a-z]+:/*", "/", root).rstrip("/"))
    relative = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", "/"), f"^{base}/", "")
    own = raw.select(relative.alias("path"), F.col("content"))
    return own.where(F.is_valid_utf8(F.col("content").cast("string"))).select("path", F.col("content").cast("string").alias("text"))


def glob_regex(pattern: str) -> str:
    """Regular expression of an ignore pattern as in ignore files."""
    anchored = "/" in pattern.rstrip("/").lstrip("!")
    own = pattern.lstrip("!").strip("/")
    body = re.sub(r"\\\*\\\*/|\\\*\\\*|\\\*|\\\?", lambda m: {r"\*\*/": "(?:.*/)?", r"\*\*": ".*", r"\*": "[^/]*", r"\?": "[^/]"}[m[0]], re.escape(own))
    return f"^{'' if anchored else '(?:.*/)?'}{body}(?:/.*)?$"


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether the last pattern that matches a path ignores it; ``!`` takes a path back."""
    out = F.lit(False)
    for p in patterns:
        p = p.strip()
        if p and not p.startswith("#"):
            out = F.when(path.rlike(glob_regex(p)), F.lit(not p.startswith("!"))).otherwise(out)
    return out


def discover(files: DataFrame, ignore: list[str] = (), include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """documents(doc_id, path, kind, code_lang, text): known kinds, not ignored, written by hand; ids hash the path."""
    own = files.dropDuplicates(["path"]).where(~ignored(F.col("path"), list(ignore)) & ~ignored(F.col("path"), list(exclude)))
    if include:
        own = own.where(ignored(F.col("path"), list(include)))
    return written_by_hand(with_kind(own)).select(F.xxhash64("path").alias("doc_id"), "path", "kind", "code_lang", "text")


#: Files with ignore patterns, the strongest first.
IGNORE_FILES = (".inkwellignore", ".ignore", ".gitignore")


def ignore_rules(files: DataFrame, names: tuple[str, ...] = IGNORE_FILES) -> DataFrame:
    """(dir, strength, seq, regex, back) of the patterns in the ignore files among ``files(path, text)``; ``back`` takes a path back."""

    @F.arrow_udf("string")
    def compiled(pattern: pa.Array) -> pa.Array:
        return pa.array([glob_regex(p) for p in pattern.to_pylist()], pa.string())

    name = F.substring_index("path", "/", -1)
    own = files.where(name.isin(*names)).select(F.regexp_extract("path", r"^(.*?)/?[^/]*$", 1).alias("dir"), (len(names) - F.array_position(F.array(*map(F.lit, names)), name)).cast("int").alias("strength"), F.posexplode(F.split("text", "\r?\n", -1)).alias("seq", "raw"))
    plain = own.withColumn("raw", F.rtrim("raw")).where("raw <> '' AND raw NOT LIKE '#%'")
    return plain.select("dir", "strength", "seq", compiled("raw").alias("regex"), F.col("raw").startswith("!").alias("back"))


def not_ignored(files: DataFrame, rules: DataFrame) -> DataFrame:
    """``files`` without those that ignore files take away: of the folders above a file the deepest with a pattern that matches decides, in it
    the strongest ignore file, in that the last pattern."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.struct(F.array_join(F.slice(parts, 1, n), "/").alias("dir"), n.alias("depth"), F.array_join(F.slice(parts, n + 1, F.size(parts)), "/").alias("sub")))
    each = files.select("path", F.explode(above).alias("x")).select("path", "x.dir", "x.depth", "x.sub")
    hit = each.join(rules, "dir").where(F.expr("sub RLIKE regex"))
    decided = hit.groupBy("path").agg(F.max_by("back", F.struct("depth", "strength", "seq")).alias("back"))
    return files.join(decided.where("NOT back").select("path"), "path", "left_anti")


def find_config(spark: SparkSession, start: str, name: str = "inkwell.toml") -> tuple[str, Config] | None:
    """(folder, configuration) of the nearest file ``name`` in the folder of ``start`` or above it, read from the file system of the path."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    here = jvm.org.apache.hadoop.fs.Path(start)
    system = here.getFileSystem(conf)
    if system.exists(here) and system.getFileStatus(here).isFile():
        here = here.getParent()
    while here is not None:
        found = jvm.org.apache.hadoop.fs.Path(here, name)
        if system.exists(found):
            text = "\n".join(r["value"] for r in spark.read.text(found.toString()).collect())
            return here.toString(), Config.read(text)
        here = here.getParent()
    return None


@dataclass(frozen=True)
class Override:
    """Options and levels for the paths that match; later ones win."""

    paths: tuple[str, ...]
    language: str | None = None
    rules: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Config:
    """The configuration of a run; unknown keys are errors."""

    fail_on: str = "warning"
    language: str = "en"
    rules: dict[str, str] = field(default_factory=dict)
    options: dict = field(default_factory=dict)
    ignore: tuple[str, ...] = ()
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    overrides: tuple[Override, ...] = ()

    @staticmethod
    def of(own: dict) -> Config:
        known = {f.name for f in fields(Config)}
        if unknown := set(own) - known:
            raise ValueError(f"unknown keys: {sorted(unknown)}")
        if own.get("fail_on", "warning") not in ("info", "warning", "error"):
            raise ValueError("fail_on is info, warning or error")
        overrides = []
        for o in own.get("overrides", ()):
            if unknown := set(o) - {f.name for f in fields(Override)}:
                raise ValueError(f"unknown keys in an override: {sorted(unknown)}")
            overrides.append(Override(**{**o, "paths": tuple(o["paths"])}))
        return Config(**{**own, "overrides": tuple(overrides), **{k: tuple(own[k]) for k in ("ignore", "include", "exclude") if k in own}})

    @staticmethod
    def read(text: str) -> Config:
        import tomllib

        return Config.of(tomllib.loads(text))


def with_overrides(documents: DataFrame, config: Config) -> DataFrame:
    """``language`` and ``levels`` (pattern -> level) of each document: the general ones, then those of every matching override."""
    language, levels = F.lit(config.language), F.create_map(*[F.lit(x) for kv in config.rules.items() for x in kv]) if config.rules else F.create_map().cast("map<string,string>")
    path = F.col("path")
    for o in config.overrides:
        hit = F.lit(False)
        for p in o.paths:
            hit = hit | path.rlike(glob_regex(p))
        if o.language:
            language = F.when(hit, o.language).otherwise(language)
        if o.rules:
            own = F.create_map(*[F.lit(x) for kv in o.rules.items() for x in kv])
            names = list(o.rules)
            keep = F.map_filter(levels, lambda k, _: ~k.isin(names))  # noqa: B023  called at once
            levels = F.when(hit, F.map_concat(keep, own)).otherwise(levels)
    return documents.withColumn("language", language).withColumn("levels", levels)
