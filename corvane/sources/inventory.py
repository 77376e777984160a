"""Inventory of a source tree: files, folders, rollups, manifests and workspace members."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as T

#: Folders that are not gone into, names of manifests, and of files that programs begin in.
IGNORED = (".git", ".venv", "__pycache__", "build", "dist", "node_modules", "target")
MANIFESTS = ("Cargo.toml", "package.json", "pyproject.toml")
LARGEST = 20


def scan(spark: SparkSession, root: str, *, ignored: Sequence[str] = IGNORED) -> DataFrame:
    """``path, size, modified, extension, language, generated, content_hash, content`` of all files below ``root``.

    Paths are relative. Spark lists the tree and reads files in parallel; columns that are not asked for, contents
    among them, are not read.
    """
    base = root.rstrip("/")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    path = F.regexp_replace("path", r"^.*?" + _quoted(base.split("://", 1)[-1]) + "/+", "")
    kept = found.withColumn("path", path).filter(~F.concat(F.lit("/"), "path").rlike("/(" + "|".join(map(_quoted, ignored)) + ")/"))
    p = F.col("path")
    return kept.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), T.extension(p).alias("extension"), T.language(p).alias("language"), T.generated(p).alias("generated"), F.sha1("content").alias("content_hash"), "content")


def _quoted(text: str) -> str:
    return "".join("\\" + c if c in r"\.^$*+?()[]{}|/-" else c for c in text)


def folders(files: DataFrame) -> DataFrame:
    """``path, depth`` of all folders that hold files."""
    up = files.select(F.explode(T.path_prefixes(F.col("path"))).alias("path")).filter("path <> '.'").distinct()
    return up.withColumn("depth", F.size(F.split("path", "/")))


def rollups(files: DataFrame, by: str) -> DataFrame:
    """Files and bytes of each extension or language, most files first."""
    return files.groupBy(by).agg(F.count("*").alias("files"), F.sum("size").alias("bytes")).orderBy(F.desc("files"), by)


def largest(files: DataFrame, n: int = LARGEST) -> DataFrame:
    return files.select("path", "size").orderBy(F.desc("size"), "path").limit(n)


def manifests(files: DataFrame) -> DataFrame:
    """``path, root, kind, name, members`` of manifests; members are the patterns of a workspace."""
    name, text = F.substring_index("path", "/", -1), F.decode("content", "utf-8")
    found = files.filter(name.isin(*MANIFESTS)).select("path", T.parent(F.col("path")).alias("root"), name.alias("file"), text.alias("text"))
    block = F.regexp_extract("text", r"(?s)(?:^|\n)\[workspace\](.*?)(?:\n\[|$)", 1)
    listed = F.regexp_extract_all(F.regexp_extract(block, r"(?s)members\s*=\s*\[(.*?)\]", 1), F.lit('"([^"]+)"'), F.lit(1))
    node = F.from_json(F.get_json_object("text", "$.workspaces"), "array<string>")
    members = F.when(F.col("file") == "Cargo.toml", listed).when(F.col("file") == "package.json", F.coalesce(node, F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))
    space = F.when(F.col("file") == "Cargo.toml", F.col("text").rlike(r"(^|\n)\[workspace\]")).otherwise(F.get_json_object("text", "$.workspaces").isNotNull())
    kind = F.when(F.col("file") == "pyproject.toml", "python-project").when(F.col("file") == "Cargo.toml", F.when(space, "cargo-workspace").otherwise("cargo-package")).otherwise(F.when(space, "node-workspace").otherwise("node-package"))
    title = F.when(F.col("file") == "package.json", F.get_json_object("text", "$.name")).otherwise(F.regexp_extract("text", r'(?m)^name\s*=\s*"([^"]+)"', 1))
    return found.select("path", "root", kind.alias("kind"), title.alias("name"), members.alias("members"))


def member_roots(found: DataFrame, folders_: DataFrame) -> DataFrame:
    """``workspace, root``: the folders that the members' patterns name; ``*`` stands for one segment."""
    asked = found.select("path", "root", F.explode("members").alias("pattern"))
    whole = F.when(F.col("root") == ".", F.col("pattern")).otherwise(F.concat_ws("/", "root", "pattern"))
    # a pattern meets folders of its own depth alone
    asked = asked.select(F.col("path").alias("workspace"), F.rtrim(whole, F.lit("/")).alias("pattern")).withColumn("depth", F.size(F.split("pattern", "/")))
    form = F.concat(F.lit("^"), F.replace(F.replace("pattern", F.lit("."), F.lit("\\.")), F.lit("*"), F.lit("[^/]*")), F.lit("$"))
    return asked.join(folders_, "depth").filter(F.regexp_like("path", form)).select("workspace", F.col("path").alias("root")).distinct()


def selected(files: DataFrame, prefixes: Sequence[str] = (), ending: str = ".rs") -> DataFrame:
    """Files with an ending that are not generated, below any of the prefixes if there are some, by path."""
    kept = files.filter(F.col("path").endswith(ending) & ~T.generated(F.col("path")))
    if prefixes:
        held = [T.within(F.col("path"), F.lit(p.rstrip("/"))) for p in prefixes]
        any_ = held[0]
        for h in held[1:]:
            any_ = any_ | h
        kept = kept.filter(any_)
    return kept.dropDuplicates(["path"]).orderBy("path")


def module_path(path, root, crate):
    """A file's module: its crate and the folders below ``root`` (and ``src``), without the names lib, main and mod."""
    below = F.regexp_replace(F.when(root == ".", path).otherwise(F.replace(path, F.concat(root, F.lit("/")), F.lit(""))), r"^src/|\.rs$", "")
    parts = F.split(F.regexp_replace(below, r"(^|/)(lib|main|mod)$", ""), "/")
    return F.array_join(F.filter(F.concat(F.array(crate), parts), lambda x: x != ""), "::")


def write(files: DataFrame, target: str) -> None:
    """The file table without contents, and its rollups, as Parquet tables below ``target``; earlier ones are replaced."""
    plain = files.drop("content")
    plain.write.mode("overwrite").parquet(f"{target}/files")
    back = files.sparkSession.read.parquet(f"{target}/files")
    for name, table in (("folders", folders(back)), ("extensions", rollups(back, "extension")), ("languages", rollups(back, "language")), ("largest", largest(back))):
        table.write.mode("overwrite").parquet(f"{target}/{name}")


def read(spark: SparkSession, target: str, name: str = "files") -> DataFrame:
    """A written table; a missing one is an error."""
    return spark.read.parquet(f"{target}/{name}")
