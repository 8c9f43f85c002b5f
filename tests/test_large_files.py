"""Large files are hashed as they are read, byte by byte as they are."""

import gzip
import hashlib

import numpy as np
import pytest

from strideframe.sources import artifacts


def test_large_files_are_streamed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(artifacts, "STREAMED", 1000)
    g = np.random.default_rng(0)
    noise = g.integers(0, 256, 300_000).astype(np.uint8).tobytes()
    contents = {
        "a.parquet": noise, "b.parquet": noise + b"\n", "c.parquet": noise[:999], "d.parquet": b"\n" * 5000, "e.parquet": b"\r\n\r" * 1500, "f.bin": b"x" * 2000,
        "g.gz": gzip.compress(noise), "h": noise[:2000], "i.tar.gz": noise[:70_000],
    }
    for folder in ("p", "q"):
        (tmp_path / "d" / folder).mkdir(parents=True)
        for name, content in contents.items():
            (tmp_path / "d" / folder / name).write_bytes(content)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")  # a file of several splits
    try:
        found = artifacts.describe_folders(spark, str(tmp_path / "d"), "x")
        assert {e["filename"]: (e["bytes"], e["sha256"]) for e in artifacts.describe(spark, str(tmp_path / "d" / "p"), "x")} == {n: (len(c), hashlib.sha256(c).hexdigest()) for n, c in contents.items()}
        assert sorted(found) == [f"file:{tmp_path}/d/p", f"file:{tmp_path}/d/q"]
        for entries in found.values():
            assert {e["filename"]: (e["bytes"], e["sha256"]) for e in entries} == {n: (len(c), hashlib.sha256(c).hexdigest()) for n, c in contents.items()}
        (tmp_path / "d" / "q" / "a.parquet").write_bytes(noise[:-1] + b"\n")
        assert [tuple(r)[1:] for r in artifacts.verify_folders(spark, found, str(tmp_path / "d")).where("status <> 'ok'").collect()] == [("a.parquet", "x", "sha256" if noise[-1:] != b"\n" else "ok")]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_a_large_file_is_never_in_memory_whole(spark, tmp_path, monkeypatch):
    """The reader of whole files refuses this one, as it does every file of over 2 GB."""
    monkeypatch.setattr(artifacts, "STREAMED", 1000, raising=False)
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.parquet").write_bytes(b"ab\n" * 5000)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "10000")
    try:
        with pytest.raises(Exception, match="exceeds|FAILED_READ_FILE"):
            spark.read.format("binaryFile").load(str(tmp_path / "m")).select("content").collect()
        assert artifacts.describe(spark, str(tmp_path / "m"), "x")[0]["sha256"] == hashlib.sha256(b"ab\n" * 5000).hexdigest()
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
