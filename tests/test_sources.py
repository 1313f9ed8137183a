"""Files of several schemes opened by tasks, clients of schemes without a connector, dialect and column scalars."""

import http.server
import sys
import threading
import types

import pytest
from pyspark.sql import functions as F

from lodestream.functions import values
from lodestream.functions.scalars import batch_sizes, parse_bytes, ratios_to_counts, share_workers
from lodestream.operators import cache, fields
from lodestream.plans.dialect import to_spark
from lodestream.sources import connectors, files


@pytest.fixture
def server():
    """Serves /x<n> with n bytes; anything else is not there."""

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            ok = self.path.startswith("/x")
            self.send_response(200 if ok else 404)
            self.end_headers()
            self.wfile.write(b"a" * int(self.path[2:]) if ok else b"")

        def log_message(self, *_):
            pass

    with http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler) as s:
        threading.Thread(target=s.serve_forever, daemon=True).start()
        yield f"http://127.0.0.1:{s.server_address[1]}"
        s.shutdown()


def test_http_in_tasks(spark, server, tmp_path):
    df = spark.createDataFrame([("a", f"{server}/x5"), ("b", f"{server}/none"), ("c", f"{server}/x70000"), ("d", None)], "key string, url string")
    got = {r.key: r.n for r in fields.load_files(df, "url", "content").select("key", F.length("content").alias("n")).collect()}
    assert got == {"a": 5, "b": None, "c": 70000, "d": None}
    done = {r.key: (r.ok, r.bytes) for r in cache.fetch(cache.fetch_plan(df, "key", ["url"], str(tmp_path), "n"), 0, "quarantine").collect()}
    assert done == {"a": (True, 5), "b": (False, 0), "c": (True, 70000)}
    assert not list(tmp_path.rglob("*.part")) and sorted(p.stat().st_size for p in tmp_path.rglob("*") if p.is_file()) == [5, 70000]


def test_local_names(tmp_path):
    path = tmp_path / "a b.txt"
    path.write_bytes(b"xyz")
    quoted = str(path).replace(" ", "%20")
    assert all(files.read_bytes(u) == b"xyz" for u in (str(path), f"file:{quoted}", f"file://{quoted}"))
    with pytest.raises(FileNotFoundError):
        files.open_stream(str(tmp_path / "none"))
    with pytest.raises(Exception, match="(?i)nowhere|scheme|filesystem"):
        files.open_stream("nowhere://x/y")


def test_sftp_client(monkeypatch):
    """Against a stand-in of the client with its classes and calls."""
    seen = []

    class Transport:
        def __init__(self, at):
            seen.append(at)

        def connect(self, username, password):
            seen.append((username, password))

        def close(self):
            seen.append("closed")

    class Client:
        @staticmethod
        def from_transport(_):
            return Client()

        def __enter__(self):
            return self

        def __exit__(self, *_):
            return False

        def open(self, path):
            import io

            return io.BytesIO(path.encode())

    monkeypatch.setitem(sys.modules, "paramiko", types.SimpleNamespace(Transport=Transport, SFTPClient=Client))
    assert files.read_bytes("sftp://me:secret@host:2200/dir/f.bin") == b"/dir/f.bin"
    assert seen == [("host", 2200), ("me", "secret"), "closed"]


def test_hub_client(monkeypatch, tmp_path):
    (tmp_path / "f").write_bytes(b"data")

    def download(repo_id, filename, repo_type):
        assert (repo_id, filename, repo_type) == ("org/name", "sub/f.parquet", "dataset")
        return str(tmp_path / "f")

    monkeypatch.setitem(sys.modules, "huggingface_hub", types.SimpleNamespace(hf_hub_download=download))
    assert files.read_bytes("hf://org/name/sub/f.parquet") == b"data"
    monkeypatch.setitem(sys.modules, "huggingface_hub", None)
    with pytest.raises(RuntimeError, match="needs the package"):
        connectors.open_url("hf://org/name/x")


@pytest.mark.parametrize(
    ("sql", "want"),
    [
        ("SELECT a FROM dataframe ORDER BY a, b DESC NULLS FIRST, f(c, d) LIMIT 3", "SELECT a FROM v ORDER BY a NULLS LAST, b DESC NULLS FIRST, f(c, d) NULLS LAST LIMIT 3"),
        ("SELECT sum(x) OVER (ORDER BY y ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) FROM dataframe", "SELECT sum(x) OVER (ORDER BY y NULLS LAST ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) FROM v"),
        ("SELECT 1 FROM dataframe ORDER BY ALL", "SELECT 1 FROM v ORDER BY ALL"),
        ("SELECT a FROM dataframe UNION ALL SELECT b FROM dataframe ORDER BY 1 OFFSET 2", "SELECT a FROM v UNION ALL SELECT b FROM v ORDER BY 1 NULLS LAST OFFSET 2"),
    ],
)
def test_null_order(sql, want):
    assert " ".join(to_spark(sql, "v").split()) == want


def test_byte_sizes_of_columns(spark):
    texts = ["1024", "7b", "1.5kb", "2MB", " 3 gb ", "0.25TB", "1pb", "1eb", ".5kb"]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string").select("t", values.byte_size(F.col("t")).alias("n"))
    got = {r.t: r.n for r in df.collect()}
    assert got[None] is None and all(got[t] == parse_bytes(t) for t in texts)
    for bad in ("", "kb", "-1", "1.5", "1xb", "1 2kb"):
        with pytest.raises(Exception, match="not a byte size"):
            spark.createDataFrame([(bad,)], "t string").select(values.byte_size(F.col("t"))).collect()


def test_apportioning():
    assert ratios_to_counts([0.2, 0.3, 0.5]) == [1, 1, 2] and ratios_to_counts([0.25, 0.25]) == [1, 1] and ratios_to_counts([0, 0.5, 0.5]) == [0, 1, 1] and ratios_to_counts([0.1, 0.25], 3) == [3, 3]
    assert ratios_to_counts([0.0, 0.0], 2) == [2, 2] and ratios_to_counts([1e-9, 1.0], precision=3) == [0, 1]
    with pytest.raises(ValueError):
        ratios_to_counts([1e-9, 2e-9], precision=3)
    for ratios, total in (([0.5, 0.3, 0.2], 7), ([1 / 3] * 3, 4), ([0.9, 0.05, 0.05], 3), ([0.26, 0.26, 0.24, 0.24], 5)):
        shares = [-(-total * r // 1) for r in ratios]
        while sum(shares) > total:
            shares[shares.index(max(shares))] -= 1
        assert share_workers(ratios, total) == shares
    assert batch_sizes(4, 64) == (64, 16, 1) and batch_sizes(4, 64, 4) == (64, 4, 4) and batch_sizes(2, None, 3, 5) == (30, 3, 5) and batch_sizes(2, 0) == (0, 0, 0)
    for bad in ((4, 6), (4, 64, 5), (4,)):
        with pytest.raises(ValueError):
            batch_sizes(*bad)
