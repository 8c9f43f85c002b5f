"""Artifact manifests and the files under them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strideframe.errors import ArtifactError

SCHEMA_VERSION = 1
STREAMED = 1 << 26  # bytes beyond which a file is hashed as it is read
ENTRY = T.StructType([T.StructField("filename", T.StringType()), T.StructField("role", T.StringType()), T.StructField("bytes", T.LongType()), T.StructField("sha256", T.StringType())])


def check_entries(entries: list[dict]) -> list[dict]:
    """Plain unique file names, known sizes and digests (of either case; lower case comes back), a role each."""
    names = [e.get("filename", "") for e in entries]
    if len(set(names)) != len(names):
        raise ArtifactError("file names repeat")
    for e in entries:
        fine = re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", e.get("filename", "")) and re.fullmatch(r"[0-9A-Fa-f]{64}", e.get("sha256", "")) and isinstance(e.get("bytes"), int) and e["bytes"] >= 0 and e.get("role")
        if not fine:
            raise ArtifactError(f"bad entry: {e}")
    return [e | {"sha256": e["sha256"].lower()} for e in entries]


def _files(spark: SparkSession, root: str, deep: bool = False) -> DataFrame:
    """(folder, filename, length, sha) of the files under ``root``, ``deep`` ones too; they are hashed where they are read.

    Files of over ``STREAMED`` bytes never lie in memory whole: one task hashes
    each as it reads it.  One without a suffix has 2 GB at most.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", deep).load(root)
    suffix = F.regexp_extract(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", 0)
    large = [r["suffix"] for r in found.where(F.col("length") > STREAMED).select(suffix.alias("suffix")).distinct().collect()]  # one row a suffix
    columns = (F.col("_metadata.file_path").alias("path"), "length", F.sha2("content", 256).alias("sha"))
    out = found.where(F.col("length") <= STREAMED).select(*columns)
    for own in large:
        if own:
            out = out.union(_streamed(found.where((F.col("length") > STREAMED) & (suffix == own)).select(*columns[:2]), root, deep, own))
        else:
            names = [r[0].rsplit("/", 1)[-1] for r in found.where((F.col("length") > STREAMED) & (suffix == "")).select("path").collect()]  # one row a file
            named = spark.read.format("binaryFile").option("recursiveFileLookup", deep).option("pathGlobFilter", "{" + ",".join(names) + "}").load(root)
            out = out.union(named.where(F.col("length") > STREAMED).select(*columns))
    return out.select(F.regexp_replace("path", "/[^/]*$", "").alias("folder"), F.element_at(F.split("path", "/"), -1).alias("filename"), "length", "sha")


def _streamed(listed: DataFrame, root: str, deep: bool, suffix: str) -> DataFrame:
    """(path, length, sha) of the ``listed`` large files of a suffix, read in order as lines, whose bytes are kept as they are."""
    reader = listed.sparkSession.read.format("text").options(lineSep="\n", recursiveFileLookup=deep, pathGlobFilter=f"*{suffix}")
    reader = reader.option("io.compression.codecs", "org.apache.hadoop.io.compress.PassthroughCodec")  # neither unpacks nor splits
    for prefix in ("", "org.apache.hadoop.shaded."):  # Spark's own Hadoop renames the option
        reader = reader.option(f"{prefix}io.compress.passthrough.extension", suffix)
    lines = reader.load(root).where(F.col("_metadata.file_size") > STREAMED)

    def hashed(batches):
        import hashlib

        import pyarrow as pa
        import pyarrow.compute as pc

        file, read, digest = None, 0, None

        def ended():  # the last line has an end or none
            with_end = digest.copy()
            with_end.update(b"\n")
            return pa.record_batch([pa.array([file]), pa.array([read]), pa.array([digest.hexdigest()]), pa.array([with_end.hexdigest()])], names=["file", "read", "sha", "sha_end"])

        for batch in batches:
            files = batch.column(1).to_numpy()
            ends = (files[1:] != files[:-1]).nonzero()[0] + 1
            for start, end in zip([0, *ends.tolist()], [*ends.tolist(), len(files)], strict=True):
                if start == end:
                    continue
                if files[start] != file:
                    if file is not None:
                        yield ended()
                    file, read, digest = int(files[start]), 0, hashlib.sha256()
                else:
                    digest.update(b"\n")
                    read += 1
                joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, end - start], pa.int32()), batch.column(0).slice(start, end - start)), pa.scalar(b"\n"))[0].as_buffer()
                digest.update(joined)
                read += joined.size
        if file is not None:
            yield ended()

    rows = lines.select(F.col("value").cast("binary").alias("line"), F.xxhash64("_metadata.file_path").alias("file"))
    rows = rows.mapInArrow(hashed, "file long, read long, sha string, sha_end string")
    sha = F.when(F.col("read") == F.col("length"), F.col("sha")).when(F.col("read") == F.col("length") - 1, F.col("sha_end"))
    return listed.join(rows, F.xxhash64("path") == F.col("file"), "left").select("path", "length", F.coalesce(sha, F.raise_error(F.concat(F.lit("not read whole: "), "path"))).alias("sha"))


def _described(files: DataFrame, role: str) -> list[dict]:
    named = files.select("folder", "filename", F.lit(role).alias("role"), F.col("length").alias("bytes"), F.col("sha").alias("sha256"))
    return [r.asDict() for r in named.orderBy("filename", "folder").collect()]  # one row a file


def describe_folders(spark: SparkSession, root: str, role: str) -> dict[str, list[dict]]:
    """Manifest entries of the files under ``root`` by the folder they lie in; names are plain, and unique in their folder only."""
    found: dict[str, list[dict]] = {}
    for r in _described(_files(spark, root, deep=True), role):
        found.setdefault(r.pop("folder"), []).append(r)
    return {folder: check_entries(entries) for folder, entries in found.items()}


def describe(spark: SparkSession, root: str, role: str) -> list[dict]:
    """Manifest entries of the files under ``root``, which are hashed where they are read."""
    entries = _described(_files(spark, root), role)
    return check_entries([{f: e[f] for f in ENTRY.names} for e in entries])


def _against(want: DataFrame, have: DataFrame, by: list[str]) -> DataFrame:
    status = F.when(F.col("length").isNull(), "missing").when(F.col("length") != F.col("bytes"), "size").when(F.col("sha") != F.col("sha256"), "sha256").otherwise("ok")
    return want.join(have, by, "left").select(*by, "role", status.alias("status"))


def verify_folders(spark: SparkSession, folders: dict[str, list[dict]], root: str) -> DataFrame:
    """(folder, filename, role, status) of the entries of several folders under ``root``; as ``verify``."""
    rows = [(folder, *[e[f] for f in ENTRY.names]) for folder, entries in folders.items() for e in check_entries(entries)]
    want = spark.createDataFrame(rows, T.StructType([T.StructField("folder", T.StringType()), *ENTRY.fields]))
    return _against(want, _files(spark, root, deep=True), ["folder", "filename"])


def verify(spark: SparkSession, entries: list[dict], root: str) -> DataFrame:
    """(filename, role, status): ``ok``, ``missing``, ``size`` or ``sha256``; files are hashed where they are read."""
    want = spark.createDataFrame([tuple(e[f] for f in ENTRY.names) for e in check_entries(entries)], ENTRY)
    return _against(want, _files(spark, root).drop("folder"), ["filename"])


def write_manifest(spark: SparkSession, entries: list[dict], path: str, *, overwrite: bool = False) -> None:
    """A version, the entries and an identity of both, as one JSON object; refuses an existing path unless told."""
    import json

    fields = {"schema_version": SCHEMA_VERSION, "artifacts": check_entries(entries)}
    line = json.dumps(fields | {"identity": identity(fields)}, sort_keys=True)
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite" if overwrite else "errorifexists").text(path)


def read_manifest(spark: SparkSession, path: str, roles: set[str] | None = None) -> list[dict]:
    """Entries of a manifest of this version; an identity that it carries must hold, other fields are let be; with ``roles``, every entry has one of them."""
    import json

    try:
        fields = json.loads(spark.read.text(path, wholetext=True).where("value <> ''").first()[0])
    except (ValueError, TypeError) as broken:
        raise ArtifactError("not a manifest") from broken
    own = {k: fields.get(k) for k in ("schema_version", "artifacts")} if isinstance(fields, dict) else {}
    if own.get("schema_version") != SCHEMA_VERSION or not isinstance(own["artifacts"], list) or not own["artifacts"]:
        raise ArtifactError("another version, or no artifacts")
    if not all(isinstance(e, dict) for e in own["artifacts"]) or ("identity" in fields and fields["identity"] != identity(own)):
        raise ArtifactError("entries aren't objects, or the identity doesn't hold")
    if roles is not None and (other := {e.get("role") for e in own["artifacts"]} - roles):
        raise ArtifactError(f"unknown roles: {sorted(map(str, other))}")
    return check_entries(own["artifacts"])


def require_verified(spark: SparkSession, entries: list[dict], root: str) -> None:
    bad = [(r.filename, r.status) for r in verify(spark, entries, root).where("status <> 'ok'").collect()]  # one row a manifest entry
    if bad:
        raise ArtifactError(f"artifacts don't hold: {sorted(bad)}")


def identity(fields: dict) -> str:
    """SHA-256 of canonical JSON: sorted keys, no blanks, no NaN."""
    import hashlib
    import json

    return hashlib.sha256(json.dumps(fields, sort_keys=True, separators=(",", ":"), allow_nan=False).encode()).hexdigest()
