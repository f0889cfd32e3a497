"""Reading and selecting source files."""

from __future__ import annotations

import os
import re
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..operators.session import checkpointed

# Names of directories that a listing skips.
SKIPPED = (
    ".bzr", ".direnv", ".eggs", ".git", ".git-rewrite", ".hg", ".mypy_cache", ".nox", ".pants.d", ".pytype", ".ruff_cache", ".snapshots", ".svn", ".tox", ".venv",
    "__pycache__", "__pypackages__", "__snapshots__", "build", "dist", "node_modules", "site-packages", "snapshots", "target", "testdata", "vendor", "venv", "zig-cache", "zig-out",
)
_BATCH_BYTES = 8 << 20


def filesystem(path: str):
    """The Arrow file system of a path or URI, and the path on it."""
    path = re.sub(r"^file:/+", "/", path.rstrip("/"))
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def list_sources(spark: SparkSession, root: str, skipped=SKIPPED) -> DataFrame:
    """path (below root), kind and size of what a walk from root finds: files, and each directory that holds a ``.git`` as a repository.

    The walk goes level by level; tasks list the directories of a level, and skipped
    names are never opened.  Symbolic links are left out.  Names that begin with ``.`` or
    ``_`` are like others.  root is a folder that all executors share; it is an error
    where there is none.
    """
    files, base = filesystem(root)
    if files.get_file_info(base).type != fs.FileType.Directory:
        raise FileNotFoundError(root)
    names = frozenset(skipped)

    def listed(batches):
        files, base = filesystem(root)
        for batch in batches:
            out = []
            for folder in batch.column(0).to_pylist():
                for i in files.get_file_info(fs.FileSelector(f"{base}/{folder}")):
                    if i.base_name == ".git":
                        out.append((folder, "repository", None))
                    if i.base_name in names or (isinstance(files, fs.LocalFileSystem) and os.path.islink(i.path)):
                        continue
                    path = f"{folder}/{i.base_name}" if folder else i.base_name
                    out.append((path, "directory" if i.type == fs.FileType.Directory else "file", i.size))
            columns = zip(*out, strict=True) if out else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], names=["path", "kind", "size"])

    front, found = spark.createDataFrame([("",)], "path string"), []
    while not found or not front.isEmpty():
        level = checkpointed(front.repartition("path").mapInArrow(listed, "path string, kind string, size long"))
        found.append(level.where("kind <> 'directory'"))
        front = level.where("kind = 'directory'").select("path")
    return reduce(DataFrame.unionByName, found)


def read_sources(spark: SparkSession, root: str, skipped=SKIPPED) -> DataFrame:
    """path (below root), source and valid of every file that list_sources finds.

    valid is false, and source null, where the bytes are no UTF-8.  Only files that
    are kept are read, by the tasks they are dealt to.
    """

    def read(batches):
        files, base = filesystem(root)
        for batch in batches:
            out, size = [], 0
            for path in batch.column(0).to_pylist():
                with files.open_input_stream(f"{base}/{path}") as f:
                    data = f.read()
                try:
                    out.append((path, data.decode(), True))
                except UnicodeDecodeError:
                    out.append((path, None, False))
                size += len(data)
                if size > _BATCH_BYTES:
                    yield rows(out)
                    out, size = [], 0
            yield rows(out)

    def rows(out):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.string(), pa.bool_()))], names=["path", "source", "valid"])

    listed = list_sources(spark, root, skipped).where("kind = 'file'").select("path")
    return listed.repartition("path").mapInArrow(read, "path string, source string, valid boolean")


def with_language(df: DataFrame, path: str = "path") -> DataFrame:
    return df.withColumns({"language": paths.language(F.col(path)), "flavor": paths.flavor(F.col(path))})


def _braces(pattern: str) -> list[str]:
    """The patterns that the first innermost ``{a,b}`` stands for, and so on."""
    m = re.search(r"\{([^{}]*)\}", pattern)
    if not m:
        return [pattern]
    return [x for part in m[1].split(",") for x in _braces(pattern[: m.start()] + part + pattern[m.end() :])]


def glob_regex(pattern: str, below: bool = True) -> str:
    """A regular expression for a glob: ``*`` and ``?`` within a segment, ``**`` across, ``[..]``, ``[!..]``, ``{a,b}``.

    A pattern without ``/`` floats; with ``below``, everything under a match matches too.
    """
    pattern = re.sub(r"^(\./)+", "", pattern.strip())
    pattern = pattern.rstrip("/") or pattern
    if "/" not in pattern:
        pattern = f"**/{pattern}"
    out = []
    for one in _braces(pattern.lstrip("/")):
        body = ""
        for token in re.findall(r"\*\*/|/\*\*$|\*\*|\*|\?|\[!?[^\]]+\]|.", one, re.S):
            if token == "**/":
                body += "(?:.*/)?"
            elif token == "/**":
                body += "/.*"
            elif token == "**":
                body += ".*"
            elif token == "*":
                body += "[^/]*"
            elif token == "?":
                body += "[^/]"
            elif len(token) > 2 and token[0] == "[":
                inner = token[1:-1]
                body += ("[^/" + inner[1:] if inner[0] == "!" else "[" + inner).replace("\\", "\\\\") + "]"
            else:
                body += re.escape(token)
        out.append(body)
    return f"^(?:{'|'.join(out)}){'(?:/.*)?' if below else ''}$"


def _any(subject: Column, patterns) -> Column:
    return subject.rlike("|".join(f"(?:{glob_regex(p)})" for p in patterns))


def glob_filter(df: DataFrame, include=(), exclude=(), path: str = "path") -> DataFrame:
    """Rows whose path some include pattern matches, as a whole or by its bare name, and no exclude pattern; no include means all."""
    keep = F.lit(True)
    if include:
        keep = _any(F.col(path), include) | _any(paths.file_name(F.col(path)), include)
    return df.where(keep & ~_any(F.col(path), exclude) if exclude else keep)


def per_file_sets(files: DataFrame, patterns: list[tuple[str, list[str]]], path: str = "path") -> DataFrame:
    """files with ``codes``: the sorted set of codes of all patterns that match the path."""
    sets = [F.when(F.col(path).rlike(glob_regex(p)) | paths.file_name(F.col(path)).rlike(glob_regex(p)), F.array(*map(F.lit, codes))).otherwise(F.array().cast("array<string>")) for p, codes in patterns]
    return files.withColumn("codes", F.array_sort(F.array_distinct(F.concat(*sets))) if sets else F.array().cast("array<string>"))


# Origins of ignore lines, the strongest first.
ORIGINS = (".ignore", ".gitignore", "exclude", "global")


def _ignore_rule(text: str) -> tuple[str, bool, bool] | None:
    """Regular expression, negated and only for directories, of a line of an ignore file; None for blanks and comments."""
    line = text.rstrip()
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[negated:]
    body = line.strip("/")
    return glob_regex(f"/{body}" if "/" in line.rstrip("/") else body, below=False), negated, line.endswith("/")


def ignore_frame(spark: SparkSession, lines: list[tuple[str, str, int, str]]) -> DataFrame:
    """base, origin, line_no, regex, negated and dirs of ignore lines (base, origin, line_no, text); blanks and comments are dropped."""
    rows = [(base, ORIGINS.index(origin), number, *rule) for base, origin, number, text in lines if (rule := _ignore_rule(text))]
    return spark.createDataFrame(rows, "base string, origin int, line_no int, regex string, negated boolean, dirs boolean")


def ignore_lines(sources: DataFrame) -> DataFrame:
    """What ignore_frame gives, of the files of sources(path, source) that are named ``.ignore`` or ``.gitignore``."""

    @F.pandas_udf("struct<regex:string,negated:boolean,dirs:boolean>")
    def rule(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_ignore_rule(t) or (None, None, None) for t in text], columns=["regex", "negated", "dirs"])

    name = paths.file_name(F.col("path"))
    own = sources.where(name.isin(*ORIGINS[:2]) & F.col("source").isNotNull())
    rows = own.select(paths.dir_of(F.col("path")).alias("base"), F.when(name == ORIGINS[0], 0).otherwise(1).alias("origin"), F.posexplode(F.split("source", "\n")).alias("line_no", "text"))
    return rows.withColumn("rule", rule("text")).select("base", "origin", "line_no", "rule.*").where("regex is not null")


def apply_ignores(files: DataFrame, ignore_lines: DataFrame, path: str = "path", repositories: DataFrame | None = None) -> DataFrame:
    """files with ``ignored``, as a walk that stops at ignored directories would find.

    ignore_lines as ignore_frame makes them.  For each directory on the way to a file,
    and the file, the last line that fits (deepest base, then latest) of the strongest
    origin decides; one ignored step ignores what is below it.  With repositories(base),
    the directories that hold one, lines of ``.gitignore`` and exclude files above the
    innermost repository around a step do not count there, and global lines count only
    inside one; without, all files are in one repository.
    """
    own = files.select(F.col(path).alias("_path")).distinct()
    steps = own.select("_path", F.explode(F.concat(F.array("_path"), F.filter(paths.ancestors(F.col("_path")), lambda d: d != ""))).alias("step"))
    steps = steps.withColumn("is_dir", F.col("step") != F.col("_path"))
    # Every directory above a step is joined with the lines bound to it: an equi-join, however many lines there are.
    placed = steps.select("step", "is_dir").distinct().withColumn("base", F.explode(paths.ancestors(F.col("step"))))
    fits = placed.join(ignore_lines, "base").where((~F.col("dirs") | F.col("is_dir")) & F.rlike(paths.relative_to(F.col("base"), F.col("step")), F.col("regex")))
    if repositories is not None:
        inner = placed.join(repositories.select("base").distinct(), "base").groupBy("step", "is_dir").agg(F.max(F.length("base")).alias("inner"))
        fits = fits.join(inner, ["step", "is_dir"], "left")
        held = F.col("inner").isNull() | (F.length("base") >= F.col("inner"))
        fits = fits.where(F.when(F.col("origin") == 3, F.col("inner").isNotNull()).otherwise((F.col("origin") == 0) | held))
    last = fits.groupBy("step", "is_dir", "origin").agg(F.max_by("negated", F.struct(F.length("base"), "line_no")).alias("negated"))
    decided = last.groupBy("step", "is_dir").agg(F.min_by("negated", "origin").alias("negated")).where("not negated")
    bad = steps.join(decided, ["step", "is_dir"], "left_semi").select("_path").distinct().withColumn("_bad", F.lit(True))
    return files.join(bad, F.col(path) == F.col("_path"), "left").withColumn("ignored", F.coalesce("_bad", F.lit(False))).drop("_path", "_bad")


def distinct_paths(df: DataFrame, path: str = "path") -> DataFrame:
    return df.select(path).distinct()


def order_paths(df: DataFrame, path: str = "path") -> DataFrame:
    """Rows in the order of path components."""
    return df.orderBy(F.split(path, "/"))


def nearest_config(files: DataFrame, configs: DataFrame, path: str = "path") -> DataFrame:
    """path and config of the closest directory above each file that holds one.

    configs: dir, name and priority; within a directory the lowest priority wins.
    Files without a config have null.
    """
    own = files.select(F.col(path).alias("path"))
    above = own.select("path", F.posexplode(paths.ancestors(F.col("path"))).alias("up", "dir"))
    found = above.join(configs, "dir").groupBy("path").agg(F.min_by(F.struct("dir", "name"), F.struct("up", "priority", "name")).alias("c"))
    full = F.when(F.col("c.dir") == "", F.col("c.name")).otherwise(F.concat("c.dir", F.lit("/"), "c.name"))
    return own.distinct().join(found.select("path", full.alias("config")), "path", "left")


def extend_chain(configs: DataFrame, most: int = 64) -> DataFrame:
    """path, depth, config and cyclic: every config that each one extends, itself at depth 0.

    configs: path, extends (null for none).  A chain that comes back to a config it
    holds already ends there, with cyclic set on its last row.
    """
    parents = configs.select(F.col("path").alias("config"), "extends")
    front = configs.select("path", F.lit(0).alias("depth"), F.col("path").alias("config"), F.array("path").alias("seen"), F.lit(False).alias("cyclic"))
    done = front
    for depth in range(1, most + 1):
        front = front.where("not cyclic").join(parents, "config").where("extends is not null")
        again = F.array_contains("seen", F.col("extends"))
        front = checkpointed(front.select("path", F.lit(depth).alias("depth"), F.col("extends").alias("config"), F.array_append("seen", F.col("extends")).alias("seen"), again.alias("cyclic")))
        if front.isEmpty():
            break
        done = done.unionByName(front)
    return done.select("path", "depth", "config", "cyclic")


def deepest_root(files: DataFrame, roots: DataFrame, path: str = "path") -> DataFrame:
    """path and root: the longest root directory that holds the file; of equal ones the one listed last (highest ordinal)."""
    own = files.select(F.col(path).alias("path"))
    above = own.select("path", F.explode(paths.ancestors(F.col("path"))).alias("root"))
    best = above.join(roots, "root").groupBy("path").agg(F.max_by(F.struct("root", "ordinal"), F.struct(F.length("root"), "ordinal")).alias("r"))
    return own.distinct().join(best.select("path", "r.root", "r.ordinal"), "path", "left")


def numbered(df: DataFrame, *keys: str, name: str = "index", partitions: int | None = None) -> DataFrame:
    """df with a running number from 0 in the order of keys, without one task that sees all rows.

    Rows are range-partitioned, sorted and counted by partition; a row's number is its place in
    its partition after the counts of the partitions before.  Without partitions there are as many
    as the session says.
    """
    n = partitions or max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # The id holds the partition above its lower 33 bits, and below them the place in it.
    parts = checkpointed(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id()))
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    counts = parts.groupBy(part.alias("_part")).count()
    before = counts.alias("a").join(counts.alias("b"), F.col("b._part") < F.col("a._part"), "left").groupBy("a._part").agg(F.coalesce(F.sum("b.count"), F.lit(0)).alias("_before"))
    return parts.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + place).drop("_part", "_before", "_id")  # one row for each partition


def sample_stride(df: DataFrame, n: int, key: str = "path") -> DataFrame:
    """Every n-th row in the order of key, from the first."""
    return numbered(df, key, name="_index").where(F.col("_index") % n == 0).drop("_index")
