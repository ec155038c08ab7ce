"""Files as tables: a directory walk as a data source, text read with its metadata, writes by mode, keyed JSON settings."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from loomgrid.operators import search as S

SCHEMA = "path string, name string, type string, size long, modified double, depth int"
MOST_BYTES = 10 << 20


class Part(InputPartition):
    """A folder to walk, and whether only its own entries are wanted."""

    def __init__(self, folder: str, depth: int, deep: bool):
        self.folder, self.depth, self.deep = folder, depth, deep


class TreeReader(DataSourceReader):
    """A task for the root's entries, and one for each of its folders. Hidden folders are pruned, not walked."""

    def __init__(self, options: dict):
        self.root = options["path"]
        self.most = int(options.get("maxdepth", options.get("maxDepth", 10)))
        self.hidden = str(options.get("includehidden", options.get("includeHidden", "false"))).lower() == "true"

    def partitions(self) -> list[InputPartition]:
        if not os.path.isdir(self.root):
            raise FileNotFoundError(self.root)
        parts: list[InputPartition] = [Part(self.root, 0, False)]
        with os.scandir(self.root) as entries:
            parts += [Part(e.path, 1, True) for e in sorted(entries, key=lambda e: e.name) if e.is_dir(follow_symlinks=False) and self.shown(e.name)]
        return parts

    def shown(self, name: str) -> bool:
        return self.hidden or not name.startswith(".")

    def read(self, partition: Part) -> Iterator[tuple]:
        todo = [(partition.folder, partition.depth)]
        while todo:
            folder, depth = todo.pop()
            if depth > self.most:
                continue
            try:
                entries = sorted(os.scandir(folder), key=lambda e: e.name)
            except OSError:
                continue
            for e in entries:
                if not self.shown(e.name):
                    continue
                is_dir = e.is_dir(follow_symlinks=False)
                try:
                    info = e.stat()
                except OSError:
                    continue  # what can't be read is left out
                yield e.path, e.name, "directory" if is_dir else "file", info.st_size, info.st_mtime, depth
                if is_dir and partition.deep:
                    todo.append((e.path, depth + 1))


class TreeSource(DataSource):
    """spark.read.format("tree").option("path", folder): one row a file or folder below it; depth 0 is the folder's own entries."""

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(self.options)


def find_files(spark: SparkSession, path: str, name_pattern: str | None = None, regex_pattern: str | None = None, file_type: str = "both", min_size: int | None = None, max_size: int | None = None, max_depth: int = 10, include_hidden: bool = False, case_sensitive: bool = True, limit: int = 1000) -> DataFrame:
    """The first entries by path for which everything given holds; folders are walked whatever the type asked for."""
    if limit < 1 or max_depth < 1 or file_type not in ("file", "directory", "both"):
        raise ValueError("limit and depth are at least 1; the type is file, directory or both")
    spark.dataSource.register(TreeSource)
    every = spark.read.format("tree").option("path", path).option("maxDepth", max_depth).option("includeHidden", include_hidden).load()
    found = every.filter(S.name_matches(F.col("name"), name_pattern, regex_pattern, case_sensitive)).filter(S.size_within(F.col("type"), F.col("size"), min_size, max_size))
    if file_type != "both":
        found = found.filter(F.col("type") == file_type)
    return S.limited(found, limit, "path")


def read_files(spark: SparkSession, path: str, max_size: int = MOST_BYTES, name_pattern: str = "*") -> DataFrame:
    """path, size, modified, content of text files below a folder, or of one file; larger ones than max_size are left out before they are read into lines."""
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    meta = files.select(F.col("value").alias("content"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("modified"))
    return meta.filter((F.col("size") <= max_size) & S.name_matches(F.col("name"), name_pattern)).select("path", "name", "size", "modified", "content", *S.text_stats(F.col("content")))


def read_file(spark: SparkSession, path: str, max_size: int = MOST_BYTES) -> DataFrame:
    """One text file as read_files has it. A path that isn't there, isn't a file or is larger than max_size raises."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        raise FileNotFoundError(path)
    status = fs.getFileStatus(at)
    if status.isDirectory():
        raise IsADirectoryError(path)
    if status.getLen() > max_size:
        raise ValueError(f"{path} has {status.getLen()} bytes, more than {max_size}")
    return read_files(spark, path, max_size)


def search_files(spark: SparkSession, path: str, pattern: str, regex: bool = False, case_sensitive: bool = True, file_pattern: str = "*", max_file_size: int = MOST_BYTES, context_lines: int = 0, limit: int = 100) -> DataFrame:
    """Matching lines of the files below a folder, first by path and line."""
    if not 0 <= context_lines <= 10 or limit < 1:
        raise ValueError("context is 0 to 10 lines, the limit at least 1")
    files = read_files(spark, path, max_file_size, file_pattern)
    return S.limited(S.search(files, pattern, "path", "content", regex, case_sensitive, context_lines), limit, "file", "line_number")


def write_text(df: DataFrame, path: str, append: bool = False, overwrite: bool = True) -> None:
    """Append wins over overwrite; neither means that the path must not be there."""
    df.write.mode("append" if append else "overwrite" if overwrite else "errorifexists").text(path)


def delete_where(df: DataFrame, gone) -> DataFrame:
    """The rows for which the condition isn't true: the relational form of deleting files."""
    return df.filter(~F.coalesce(gone, F.lit(False)))


def is_yaml(path: str) -> bool:
    return path.lower().endswith((".yml", ".yaml"))


def settings(path: str, defaults: dict | None = None, overrides: dict | None = None) -> dict:
    """JSON or YAML settings over defaults, overrides over both; a file that is missing, broken or no mapping leaves the defaults."""
    try:
        text = Path(path).read_text()
        own = parsed_yaml(text) if is_yaml(path) else json.loads(text)
    except (OSError, ValueError):
        own = {}
    return deep_merge(deep_merge(defaults or {}, own if isinstance(own, dict) else {}), overrides or {})


def parsed_yaml(text: str):
    """A ValueError where YAML is broken; an ImportError without a YAML library."""
    import yaml

    try:
        return yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise ValueError(str(e)) from e


def save_settings(values: dict, path: str) -> None:
    """YAML by the file's ending, else JSON with an indent of two."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    if is_yaml(path):
        import yaml

        Path(path).write_text(yaml.safe_dump(values, sort_keys=False))
    else:
        Path(path).write_text(json.dumps(values, indent=2))


def from_environment(prefix: str, values: dict[str, str] | None = None) -> dict:
    """Settings from variables: PREFIX_A__B=1 is {"a": {"b": 1}}; values that are JSON are read as such."""
    out: dict = {}
    for k, v in sorted((values if values is not None else os.environ).items()):
        if k.startswith(prefix):
            try:
                value = json.loads(v)
            except ValueError:
                value = v
            for part in reversed(k[len(prefix) :].lower().split("__")):
                value = {part: value}
            out = deep_merge(out, value)
    return out


def deep_merge(left: dict, right: dict) -> dict:
    """Right wins; two dicts under one key are merged, anything else is replaced."""
    out = dict(left)
    for k, v in right.items():
        out[k] = deep_merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def lookup(values: dict, dotted: str, default=None):
    """The value under a dotted path."""
    for k in dotted.split("."):
        if not isinstance(values, dict) or k not in values:
            return default
        values = values[k]
    return values
