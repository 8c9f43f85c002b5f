"""NumPy array files as rows, and generated windows behind an identity and a checksum."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe.errors import ArtifactError
from strideframe.sources.artifacts import describe

BATCH = 1024  # rows
# Names of a cache's identity fields.
IDENTITY = (
    "sensor_configuration", "held_out_subject", "vae_checkpoint_sha256", "flow_checkpoint_sha256", "config_identity", "seed", "steps", "samples_per_class", "implementation_version",
)
ASKED = ("sensor_configuration", "held_out_subject", "seed", "steps", "samples_per_class")


def _opened(content: bytes):
    import io

    import numpy as np

    return np.load(io.BytesIO(content), allow_pickle=False)


def read_array(spark: SparkSession, path: str, key: str = "input") -> DataFrame:
    """(path, i, shape, x) of ``.npy`` files, or of ``.npz`` files with one array or one named ``key``: a row an item of the first axis.

    Arrays have three axes and finite numbers.  A file is read by one task
    (binary files have 2 GB at most); files spread over tasks.
    """

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for part in parts:
            for name, content in zip(part["path"], part["content"], strict=True):
                found = _opened(content)
                if hasattr(found, "files"):
                    if key not in found.files and len(found.files) != 1:
                        raise ArtifactError(f"{name} holds several arrays, none named {key!r}")
                    found = found[key if key in found.files else found.files[0]]
                if found.ndim != 3 or not np.issubdtype(found.dtype, np.number) or not np.isfinite(found).all():
                    raise ArtifactError(f"{name} isn't a finite array of three axes")
                for at in range(0, len(found), BATCH):
                    some = found[at : at + BATCH]
                    yield pd.DataFrame({"path": name, "i": range(at, at + len(some)), "shape": [list(found.shape[1:])] * len(some), "x": list(some.reshape(len(some), -1).astype("float32"))})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(rows, "path string, i long, shape array<int>, x array<float>")


def load_synthetic(spark: SparkSession, path: str) -> DataFrame:
    """(i, label, shape, x) of an ``.npz`` file with ``X_syn`` (N, channels, time) and ``y_syn`` (N)."""

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, content in zip(part["path"], part["content"], strict=True):
                found = _opened(content)
                if not hasattr(found, "files") or not {"X_syn", "y_syn"} <= set(found.files):
                    raise ArtifactError(f"{name} has no X_syn and y_syn")
                x, y = found["X_syn"].astype("float32"), found["y_syn"].astype("int64").reshape(-1)
                if x.ndim != 3 or len(x) != len(y):
                    raise ArtifactError(f"{name}: shapes don't fit")
                for at in range(0, len(x), BATCH):
                    some = x[at : at + BATCH]
                    yield pd.DataFrame({"i": range(at, at + len(some)), "label": y[at : at + BATCH], "shape": [list(x.shape[1:])] * len(some), "x": list(some.reshape(len(some), -1))})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(rows, "i long, label long, shape array<int>, x array<float>")


def find_manifest(spark: SparkSession, path: str) -> str:
    """The one manifest beside a cache: of its stem, of its whole name, or the folder's."""
    folder, name = path.rsplit("/", 1)
    names = {f"{name.rsplit('.', 1)[0]}.manifest.json", f"{name}.manifest.json", "manifest.json"}
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*manifest.json").load(folder).select("path")
    found = [r.path for r in files.where(F.element_at(F.split("path", "/"), -1).isin(list(names))).collect()]
    if len(found) != 1:
        raise ArtifactError(f"{len(found)} manifests beside {name}")
    return found[0]


def check_manifest(spark: SparkSession, path: str, manifest: str, **asked) -> dict:
    """The manifest, when its identity is whole and the one asked for and the file is the one it means; all breaches are named in one error."""
    if set(asked) != set(ASKED):
        raise ArtifactError(f"ask for {ASKED}")
    try:
        fields = json.loads(spark.read.text(manifest, wholetext=True).first()[0].removeprefix("\ufeff"))
        own = dict(fields["identity"])
    except (ValueError, TypeError, KeyError) as broken:
        raise ArtifactError("not a manifest with an identity") from broken
    (file,) = describe(spark, path, "cache")  # hashed where it is read
    name_said = fields.get("array_filename") or file["filename"]
    digest = str(fields.get("array_sha256") or fields.get("cache_sha256")).lower()
    rules = {name: (lambda v, name=name: v == asked[name]) for name in ASKED} | {name: (lambda v: isinstance(v, str) and v.strip() != "") for name in IDENTITY if name not in ASKED}
    broken = [f"{name}: {own.get(name)!r}" for name, rule in rules.items() if name not in own or not rule(own.get(name))]
    broken += [f"file name: {name_said!r}"] * (name_said != file["filename"]) + [f"checksum: {digest}"] * (digest != file["sha256"])
    if broken:
        raise ArtifactError(f"the manifest doesn't hold: {', '.join(broken)}")
    return fields


def load_checked_synthetic(spark: SparkSession, path: str, **asked) -> tuple[DataFrame, dict]:
    """Generated windows, only once their manifest holds."""
    fields = check_manifest(spark, path, find_manifest(spark, path), **asked)
    return load_synthetic(spark, path), fields


def read_fold_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of folds: JSON files of one object or a list each; a byte order mark is taken off."""
    return spark.read.json(path, multiLine=True)
