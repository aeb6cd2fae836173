"""Source files of a workspace as rows, and the crates that manifests declare."""

from __future__ import annotations

import os
import posixpath
import tomllib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.schema import LANGUAGES, TABLES

# Folders that hold no sources.
SKIPPED = ["target", "node_modules", "vendor", "obj", "build", "dist", "__pycache__"]


def language(path: Column) -> Column:
    suffix = F.lower(F.element_at(F.split(path, r"\."), -1))
    out = None
    for s, name in LANGUAGES.items():
        out = F.when(suffix == s, name) if out is None else out.when(suffix == s, name)
    return out


def is_skipped(path: Column) -> Column:
    """Whether a folder on the way is hidden or holds build products; bin counts unless it is in src."""
    parts = F.split(path, "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    plain = F.exists(folders, lambda d: d.isin(SKIPPED) | d.startswith("."))
    binaries = F.exists(F.transform(folders, lambda d, i: (d == "bin") & ((i == 0) | (F.get(folders, i - 1) != "src"))), lambda x: x)
    return plain | binaries


def scan_sources(spark: SparkSession, root: str) -> DataFrame:
    """(path, language, mtime_ns, size_bytes, content binary) of all sources under a folder, empty files too.

    The binary reader finds suffixes in either case; it drops empty files, which a listing of the local folder adds.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{[rR][sS],[cC][sS]}").load(root)
    base = root.removeprefix("file://").rstrip("/") + "/"
    path = F.element_at(F.split(F.url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B"))), base, 2), -1)
    out = files.select(path.alias("path"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), F.col("length").alias("size_bytes"), "content")
    hollow = []
    if "://" not in root or root.startswith("file://"):
        for folder, _, names in os.walk(base):
            for n in names:
                full = os.path.join(folder, n)
                if n.lower().endswith((".rs", ".cs")) and not os.path.getsize(full):
                    hollow.append((os.path.relpath(full, base), os.stat(full).st_mtime_ns // 1000 * 1000, 0, bytearray()))
    if hollow:
        out = out.unionByName(spark.createDataFrame(hollow, out.schema))
    return out.where(~is_skipped(F.col("path"))).withColumn("language", language(F.col("path")))


def split_valid(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files with text, errors (path, reason)): what is not UTF-8 is an error of its own file only."""
    ok = F.is_valid_utf8(F.col("content").cast("string"))
    good = files.where(ok).withColumn("text", F.col("content").cast("string")).drop("content")
    return good, files.where(~ok).select("path", F.lit("not UTF-8").alias("reason"))


def _target(path: str | None) -> str | None:
    """A path of a manifest that stays inside its crate, else nothing."""
    if not path or path.startswith("/") or ".." in path.split("/"):
        return None
    return posixpath.normpath(path)


def _crate(root: str, folder: str, manifest: dict) -> tuple | None:
    name = (manifest.get("package") or {}).get("name")
    if not name:
        return None

    def there(p: str) -> bool:
        return os.path.isfile(os.path.join(root, folder, p))

    lib = _target((manifest.get("lib") or {}).get("path")) or ("src/lib.rs" if there("src/lib.rs") else None)
    bins = [(b["name"], _target(b.get("path")) or f"src/bin/{b['name']}.rs") for b in manifest.get("bin") or [] if b.get("name")]
    if not bins and there("src/main.rs"):
        bins = [(name, "src/main.rs")]
    return name, folder, lib, bins


def _load(path: str) -> dict | None:
    try:
        with open(path, "rb") as f:
            return tomllib.load(f)
    except (OSError, tomllib.TOMLDecodeError):
        return None


def discover_crates(spark: SparkSession, root: str) -> DataFrame:
    """(name, path, lib_path, bin_paths) of a package, a workspace's members, or both; a member that cannot be read is left out.

    Members are folders, or all folders in one (prefix/*). Manifests are few and are read on the driver.
    """
    root = root.removeprefix("file://")
    top = _load(os.path.join(root, "Cargo.toml")) or {}
    folders = [""] if top.get("package") else []
    for member in (top.get("workspace") or {}).get("members") or []:
        if member.endswith("/*"):
            base = os.path.join(root, member[:-2])
            folders += sorted(f"{member[:-2]}/{d}" for d in (os.listdir(base) if os.path.isdir(base) else []) if os.path.isfile(os.path.join(base, d, "Cargo.toml")))
        else:
            folders.append(posixpath.normpath(member))
    found = [c for f in dict.fromkeys(folders) if (m := _load(os.path.join(root, f, "Cargo.toml"))) and (c := _crate(root, f, m))]
    return spark.createDataFrame(found, TABLES["crates"])


def file_crates(files: DataFrame, crates: DataFrame) -> DataFrame:
    """(file_id, path, crate, crate_path, lib_path, bin_paths, inner): the crate of the longest folder above; inner is the path within it.

    Files outside all crates are in no row.
    """
    from quarry.functions.text import ancestors

    up = files.select(F.col("id").alias("file_id"), "path", F.posexplode(ancestors(F.col("path"))).alias("depth", "folder"))
    hit = up.join(crates.withColumnRenamed("path", "folder"), "folder")
    best = hit.groupBy("file_id", "path").agg(F.max_by(F.struct("name", "folder", "lib_path", "bin_paths"), "depth").alias("c"))
    inner = F.when(F.col("c.folder") == "", F.col("path")).otherwise(F.substring("path", F.length("c.folder") + 2, F.length("path")))
    return best.select("file_id", "path", F.col("c.name").alias("crate"), F.col("c.folder").alias("crate_path"), "c.lib_path", "c.bin_paths", inner.alias("inner"))


def homes(files: DataFrame, owned: DataFrame) -> DataFrame:
    """(file_id, crate) of every file; one outside all crates has `orphan:` and the first part of its path."""
    rows = files.select(F.col("id").alias("file_id"), "path").join(owned.select("file_id", "crate"), "file_id", "left")
    return rows.select("file_id", F.coalesce("crate", F.concat(F.lit("orphan:"), F.substring_index("path", "/", 1))).alias("crate"))


def module_paths(owned: DataFrame) -> DataFrame:
    """(file_id, module_path): crate::a::b, or the binary's name as the first part; the stems mod, lib and main are dropped."""
    stem = F.regexp_replace("inner", r"\.[^./]*$", "")
    is_bin = F.exists("bin_paths", lambda b: (b["path"] == F.col("inner")) & b["path"].startswith("src/bin/"))
    name = F.get(F.filter("bin_paths", lambda b: b["path"] == F.col("inner")), 0)["name"]
    parts = F.filter(F.split(F.regexp_replace(stem, "^src/?", ""), "/"), lambda x: x != "")
    last = F.element_at(parts, -1)
    kept = F.when((F.size(parts) > 0) & last.isin("mod", "lib", "main"), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    out = F.when(is_bin, name).when(F.col("inner").startswith("src/"), F.array_join(F.concat(F.array(F.lit("crate")), kept), "::")).otherwise("")
    return owned.select("file_id", out.alias("module_path"))


def module_files(owned: DataFrame, modules: DataFrame) -> DataFrame:
    """(module, scope, file_id): names under which a file's module can be reached, crate::.. within its crate and name::.. from all others."""
    rows = owned.join(modules, "file_id").where("module_path != ''").select("file_id", "crate", "module_path", "inner")
    own = rows.select(F.col("module_path").alias("module"), F.col("crate").alias("scope"), "file_id", "inner")
    far = rows.where("module_path = 'crate' or startswith(module_path, 'crate::')")
    far = far.select(F.concat(F.replace(F.col("crate"), F.lit("-"), F.lit("_")), F.substring("module_path", 6, F.length("module_path"))).alias("module"), F.lit("*").alias("scope"), "file_id", "inner")
    # a.rs comes before a/mod.rs, and a library before a binary
    order = F.struct(F.when(F.col("inner").endswith("/mod.rs"), 1).otherwise(0), F.when(F.col("inner").endswith("main.rs"), 1).otherwise(0), "file_id")
    return own.unionByName(far).groupBy("module", "scope").agg(F.min_by("file_id", order).alias("file_id"))
