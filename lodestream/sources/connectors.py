"""Where each URL scheme is read: Spark's own connectors, or a Python data source for the others."""

from __future__ import annotations

import os
import shutil
from collections.abc import Iterator
from urllib.parse import urlparse

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Scheme of a URL to the Hadoop scheme and the package that serves it.
HADOOP = {
    "": ("file", None), "file": ("file", None), "s3": ("s3a", "hadoop-aws"), "s3a": ("s3a", "hadoop-aws"), "gs": ("gs", "gcs-connector"), "oci": ("oci", "oci-hdfs-connector"),
    "azure": ("wasbs", "hadoop-azure"), "azure-dl": ("abfss", "hadoop-azure"), "dbfs": ("dbfs", None), "hdfs": ("hdfs", None), "http": ("http", None), "https": ("https", None),
}
PYTHON = {"sftp": "paramiko", "hf": "huggingface_hub"}


def to_hadoop(url: str) -> str:
    """The URL as Spark's readers take it."""
    scheme = urlparse(url).scheme
    if scheme in PYTHON:
        raise ValueError(f"{scheme} has no Hadoop connector; read it with the data source 'lodestream_files'")
    if scheme not in HADOOP:
        raise ValueError(f"no connector for {url!r}")
    target, _ = HADOOP[scheme]
    return url if not scheme or target == scheme else target + url[len(scheme) :]


def client(scheme: str):
    """The Python module that reads a scheme, or a clear error where it is not installed."""
    import importlib

    try:
        return importlib.import_module(PYTHON[scheme])
    except ImportError as e:
        raise RuntimeError(f"reading {scheme} needs the package {PYTHON[scheme]}") from e


def open_url(url: str) -> bytes:
    """Contents of a URL that has no Hadoop connector, or of a local file."""
    u = urlparse(url)
    if u.scheme in ("", "file"):
        with open(u.path, "rb") as f:
            return f.read()
    if u.scheme == "sftp":
        paramiko = client("sftp")
        transport = paramiko.Transport((u.hostname, u.port or 22))
        try:
            transport.connect(username=u.username, password=u.password)
            with paramiko.SFTPClient.from_transport(transport).open(u.path) as f:
                return f.read()
        finally:
            transport.close()
    if u.scheme == "hf":
        with open(client("hf").hf_hub_download(repo_id="/".join([u.netloc, *u.path.split("/")[1:2]]), filename="/".join(u.path.split("/")[2:]), repo_type="dataset"), "rb") as f:
            return f.read()
    raise ValueError(f"no Python reader for {url!r}")


class FilesSource(DataSource):
    """`spark.read.format("lodestream_files").option("urls", "a,b")`: (path, content), one partition per URL."""

    @classmethod
    def name(cls) -> str:
        return "lodestream_files"

    def schema(self) -> str:
        return "path string, content binary"

    def reader(self, schema) -> DataSourceReader:
        return FilesReader([u for u in self.options.get("urls", "").split(",") if u])


class FilesReader(DataSourceReader):
    def __init__(self, urls: list[str]):
        self.urls = urls

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(u) for u in self.urls]

    def read(self, partition: InputPartition) -> Iterator[tuple[str, bytes]]:
        yield partition.value, open_url(partition.value)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FilesSource)


def upload(source: str, destination: str) -> None:
    """Moves a local file, through a temporary name."""
    os.makedirs(os.path.dirname(destination) or ".", exist_ok=True)
    shutil.copyfile(source, f"{destination}.part")
    os.replace(f"{destination}.part", destination)
    os.remove(source)
