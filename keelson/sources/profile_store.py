"""Profiles as one JSON file per query, in a local folder or any file system that Spark reaches."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Protocol
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..autofix.profile import Profile


class Backend(Protocol):
    def read(self, name: str) -> str | None: ...
    def write(self, name: str, text: str) -> None: ...
    def names(self) -> list[str]: ...


class LocalBackend:
    def __init__(self, folder: str):
        self.folder = Path(folder)

    def read(self, name: str) -> str | None:
        path = self.folder / name
        return path.read_text() if path.is_file() else None

    def write(self, name: str, text: str) -> None:
        self.folder.mkdir(parents=True, exist_ok=True)
        part = self.folder / f".{name}.part"
        part.write_text(text)
        part.replace(self.folder / name)

    def names(self) -> list[str]:
        return [p.name for p in self.folder.glob("*.json")] if self.folder.is_dir() else []


class HadoopBackend:
    """hdfs, s3a and so on, by Hadoop's FileSystem."""

    def __init__(self, spark: SparkSession, uri: str):
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.folder = self._jvm.org.apache.hadoop.fs.Path(uri)
        self.fs = self.folder.getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self.folder, name)

    def read(self, name: str) -> str | None:
        path = self._path(name)
        if not self.fs.exists(path):
            return None
        stream = self.fs.open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        stream = self.fs.create(self._path(name), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def names(self) -> list[str]:
        if not self.fs.exists(self.folder):
            return []
        return [s.getPath().getName() for s in self.fs.listStatus(self.folder) if s.getPath().getName().endswith(".json")]


class ProfileStore:
    """A broken or missing profile reads as none, and a failed write is forgotten: tuning must never fail a query."""

    def __init__(self, backend: Backend):
        self.backend = backend

    @classmethod
    def at(cls, spark: SparkSession | None, uri: str) -> ProfileStore:
        scheme = urlparse(uri).scheme
        if spark is not None and len(scheme) > 1 and scheme != "file":
            return cls(HadoopBackend(spark, uri))
        return cls(LocalBackend(urlparse(uri).path if scheme == "file" else uri))

    def load(self, fingerprint: str) -> Profile | None:
        try:
            text = self.backend.read(f"{fingerprint}.json")
            return Profile.from_json(json.loads(text)) if text else None
        except Exception:  # noqa: BLE001
            return None

    def save(self, profile: Profile) -> bool:
        try:
            self.backend.write(f"{profile.fingerprint}.json", json.dumps(profile.to_json(), indent=1))
            return True
        except Exception:  # noqa: BLE001
            return False

    def all(self) -> list[Profile]:
        """Newest first."""
        try:
            found = [self.load(n.removesuffix(".json")) for n in self.backend.names()]
        except Exception:  # noqa: BLE001
            return []
        return sorted((p for p in found if p), key=lambda p: -p.updated_ts)


PROFILE_ROW = "fingerprint string, sample string, status string, baseline_ms long, best_ms long, saved_percent double, best_hints array<string>, pending_hints array<string>, n_attempts int, updated_ts long, recommendations array<string>"


def profiles_frame(spark: SparkSession, store: ProfileStore) -> DataFrame:
    """The profiles as a table, newest first."""
    rows = [(p.fingerprint, p.sample, p.status, p.baseline_ms, p.best_ms, p.saved_percent, [h.render() for h in p.best_hints], [h.render() for h in p.pending_hints], len(p.attempts), p.updated_ts, list(p.recommendations)) for p in store.all()]
    return spark.createDataFrame(rows, PROFILE_ROW).orderBy(F.desc("updated_ts"))
