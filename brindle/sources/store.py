"""Object stores with conditional writes.

Every key is a chain of versions, and a version is created by an exclusive create; its number is the etag.
So a compare-and-swap is "create the version after the one I read", which any file system with exclusive
creation can do.
"""

from __future__ import annotations

import os
import threading
import uuid
from collections.abc import Mapping


class NotFound(KeyError):
    """The key does not exist."""


class PreconditionFailed(Exception):
    """The key exists already, or has changed since it was read."""


class MemoryStore:
    """Objects in this process."""

    def __init__(self) -> None:
        self._lock, self._data = threading.Lock(), {}

    def _create(self, key: str, version: int, body: bytes) -> None:
        with self._lock:
            chain = self._data.setdefault(key, {})
            if version in chain:
                raise PreconditionFailed(key)
            chain[version] = bytes(body)

    def _newest(self, key: str) -> int:
        with self._lock:
            return max(self._data.get(key, {}), default=0)

    def _read(self, key: str, version: int) -> bytes:
        with self._lock:
            return self._data[key][version]

    def list(self, prefix: str) -> list[str]:
        with self._lock:
            return sorted(k for k in self._data if k.startswith(prefix))

    def get(self, key: str) -> tuple[bytes, str]:
        """The body and its etag."""
        version = self._newest(key)
        if not version:
            raise NotFound(key)
        return self._read(key, version), str(version)

    def put_if_absent(self, key: str, body: bytes) -> str:
        self._create(key, 1, body)
        return "1"

    def put_cas(self, key: str, body: bytes, etag: str) -> str:
        """Writes if the key is as it was when ``etag`` was read; a missing key fails too."""
        if self._newest(key) != int(etag) or not int(etag):
            raise PreconditionFailed(key)
        self._create(key, int(etag) + 1, body)
        return str(int(etag) + 1)

    def put(self, key: str, body: bytes) -> str:
        while True:
            version = self._newest(key) + 1
            try:
                self._create(key, version, body)
                return str(version)
            except PreconditionFailed:
                continue


class FileStore(MemoryStore):
    """Objects below a folder: a folder a key, a file a version, linked into place whole and never replaced."""

    def __init__(self, root: str):
        self.root = root
        os.makedirs(root, exist_ok=True)

    def _folder(self, key: str) -> str:
        return os.path.join(self.root, *key.split("/")) + "@"

    def _create(self, key: str, version: int, body: bytes) -> None:
        folder = self._folder(key)
        os.makedirs(folder, exist_ok=True)
        temporary = os.path.join(folder, f".{uuid.uuid4().hex}")
        with open(temporary, "wb") as f:
            f.write(body)
        try:
            os.link(temporary, os.path.join(folder, f"{version:020d}"))
        except FileExistsError as e:
            raise PreconditionFailed(key) from e
        finally:
            os.unlink(temporary)

    def _newest(self, key: str) -> int:
        try:
            return max((int(x) for x in os.listdir(self._folder(key)) if not x.startswith(".")), default=0)
        except FileNotFoundError:
            return 0

    def _read(self, key: str, version: int) -> bytes:
        with open(os.path.join(self._folder(key), f"{version:020d}"), "rb") as f:
            return f.read()

    def list(self, prefix: str) -> list[str]:
        found = []
        for folder, _, files in os.walk(self.root):
            if folder.endswith("@") and any(not x.startswith(".") for x in files):
                found.append(os.path.relpath(folder, self.root)[:-1].replace(os.sep, "/"))
        return sorted(k for k in found if k.startswith(prefix))


class HadoopStore(MemoryStore):
    """The same on any Hadoop file system with an atomic rename (hdfs, abfs, viewfs of them; local files are linked).

    A version is written whole under another name and renamed without replacing, so it appears complete and once. A plain
    s3a bucket has no such rename: there two writers can both succeed, and ``exclusive`` says so."""

    def __init__(self, spark, root: str):
        self._jvm, self.root = spark.sparkContext._jvm, root.rstrip("/")
        self._gateway, self._conf = spark.sparkContext._gateway, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)
        uri = self._fs.getUri()
        self._local = uri.getScheme() == "file"
        self.exclusive = uri.getScheme() not in ("s3", "s3a", "s3n")

    def _path(self, key: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{key}" if key else self.root)

    def _create(self, key: str, version: int, body: bytes) -> None:
        final, temporary = (self._path(f"{key}@/{name}") for name in (f"{version:020d}", f".{uuid.uuid4().hex}"))
        out = self._fs.create(temporary, False)
        out.write(bytearray(body))
        out.close()
        try:
            if self._local:
                os.link(temporary.toUri().getPath(), final.toUri().getPath())
            else:
                never_replace = self._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
                self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self._conf).rename(temporary, final, never_replace)
        except Exception as e:
            if isinstance(e, FileExistsError) or "FileAlreadyExists" in str(e):
                raise PreconditionFailed(key) from e
            raise
        finally:
            self._fs.delete(temporary, False)

    def _newest(self, key: str) -> int:
        folder = self._path(f"{key}@")
        if not self._fs.exists(folder):
            return 0
        return max((int(x.getPath().getName()) for x in self._fs.listStatus(folder) if not x.getPath().getName().startswith(".")), default=0)

    def _read(self, key: str, version: int) -> bytes:
        stream = self._fs.open(self._path(f"{key}@/{version:020d}"))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def list(self, prefix: str) -> list[str]:
        files, found = self._fs.listFiles(self._path(""), True), set()
        start = len(self._jvm.org.apache.hadoop.fs.Path(self.root).toUri().getPath()) + 1
        while files.hasNext():
            path = files.next().getPath()
            folder = path.getParent().toUri().getPath()
            if folder.endswith("@") and not path.getName().startswith("."):
                found.add(folder[start:-1])
        return sorted(k for k in found if k.startswith(prefix))


#: Settings of an S3 endpoint, and those that may be left out.
S3_SETTINGS = {"BRINDLE_S3_ENDPOINT": "endpoint", "BRINDLE_S3_BUCKET": None, "BRINDLE_S3_ACCESS_KEY": "access.key", "BRINDLE_S3_SECRET_KEY": "secret.key", "BRINDLE_S3_REGION": "endpoint.region"}
S3_OPTIONAL = {"BRINDLE_S3_REGION"}


def s3_store(spark, environment: Mapping[str, str] = os.environ) -> HadoopStore:
    """A store in the bucket that the environment names; all settings that are missing are named at once.

    They hold for that bucket alone, so tables in others keep theirs. The S3 connector must be on Spark's class path."""
    missing = [x for x in S3_SETTINGS if x not in S3_OPTIONAL and not environment.get(x)]
    if missing:
        raise ValueError(f"missing settings: {', '.join(missing)}")
    bucket, conf = environment["BRINDLE_S3_BUCKET"], spark.sparkContext._jsc.hadoopConfiguration()
    for name, option in S3_SETTINGS.items():
        if option and environment.get(name):
            conf.set(f"fs.s3a.bucket.{bucket}.{option}", environment[name])
    conf.set(f"fs.s3a.bucket.{bucket}.path.style.access", "true")
    return HadoopStore(spark, f"s3a://{bucket}")
