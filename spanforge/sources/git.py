"""Files of a git tree as DataFrames. Listing runs on the driver, contents in tasks."""

from __future__ import annotations

import subprocess

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def run_git(root: str, *args: str) -> bytes:
    return subprocess.run(["git", "-C", root, *args], check=True, capture_output=True).stdout


def find_root(cwd: str = ".") -> str:
    return run_git(cwd, "rev-parse", "--show-toplevel").decode().strip()


def resolve(root: str, ref: str) -> str:
    return run_git(root, "rev-parse", "--verify", ref).decode().strip()


def staged_tree(root: str) -> str:
    """The staging area as a tree id; nothing is committed."""
    return run_git(root, "write-tree").decode().strip()


def tree(spark: SparkSession, root: str, ref: str = "HEAD") -> DataFrame:
    """(path, blob_sha) of the blobs at a ref; paths are NUL-separated, so unquoted."""
    rows = []
    for line in run_git(root, "ls-tree", "-r", "-z", ref).split(b"\0"):
        if line:
            meta, path = line.split(b"\t", 1)
            _, kind, sha = meta.decode().split(" ")
            if kind == "blob":
                rows.append((path.decode("utf-8", "surrogateescape").encode("utf-8", "replace").decode(), sha))
    return spark.createDataFrame(rows, "path string, blob_sha string")


def with_contents(files: DataFrame, root: str) -> DataFrame:
    """``files`` and the content of their blobs, by one batch process per task.

    The repository must be readable under ``root`` on every executor.
    """
    at = files.columns.index("blob_sha")

    def run(batches):
        p = subprocess.Popen(["git", "-C", root, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE)
        try:
            for b in batches:
                out = []
                for sha in b.column(at).to_pylist():
                    p.stdin.write(sha.encode() + b"\n")
                    p.stdin.flush()
                    head = p.stdout.readline().split()
                    if head[-1] == b"missing":
                        raise FileNotFoundError(f"blob {sha}")
                    out.append(p.stdout.read(int(head[2])))
                    p.stdout.read(1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], [*b.schema.names, "content"])
        finally:
            p.stdin.close()
            p.wait()

    return files.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields) + ", content binary")


def directory(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of all files below a folder, without git."""
    from pyspark.sql import functions as F

    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").split(":")[-1].lstrip("/")
    return df.select(F.regexp_replace("path", f"^.*?{base}/", "").alias("path"), "content")
