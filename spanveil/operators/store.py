"""Vault tables on disk: numbered versions of two Parquet tables, originals encrypted, and a lock for the writer."""

from __future__ import annotations

import os
import secrets
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import paths_below, remove

LABEL = "spanveil-vault-2"
KEEP = 2


class VaultStore:
    """``path``: a folder URI; ``key``: 16, 24 or 32 bytes, or None for plain text.

    A version is a folder whose name has a number, and counts from when its last file, DONE, is there; readers take
    the highest whole one, so a writer that dies leaves the one before.  lock() is a file that only one writer can
    create.  Originals are AES-GCM encrypted with the format label as associated data; a wrong key or a changed byte
    fails the read.  The key comes from a one-row table, so plans and event logs don't show it.
    """

    def __init__(self, spark: SparkSession, path: str, key: bytes | None = None, wait: float = 60.0):
        self.spark, self.path, self.key, self.wait = spark, path.rstrip("/"), key, wait

    def _cipher(self, df: DataFrame, back: bool) -> DataFrame:
        if self.key is None:
            return df
        key = self.spark.createDataFrame([(bytearray(self.key),)], "__key binary")
        label, mode, padding, k, v = F.lit(LABEL), F.lit("GCM"), F.lit("DEFAULT"), F.col("__key"), F.col("original")
        new: Column = F.call_function("aes_decrypt", F.unhex(v), k, mode, padding, label).cast("string") if back else F.hex(F.call_function("aes_encrypt", F.encode(v, "utf-8"), k, mode, padding, F.lit("").cast("binary"), label))
        return df.join(F.broadcast(key)).withColumn("original", new).drop("__key")  # one row

    def _fs(self):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def versions(self) -> list[str]:
        names = [p.rsplit("/", 1)[1] for p in paths_below(self.spark, self.path)]
        return [n for n in names if n.startswith("v-") and self._fs().exists(self._at(f"{n}/DONE"))]

    def current(self) -> str | None:
        return max(self.versions(), default=None)

    def read(self) -> DataFrame | None:
        return self.read_both()[0]

    def read_both(self) -> tuple[DataFrame | None, DataFrame | None]:
        """(mappings, counters), None each where nothing was written yet."""
        if (version := self.current()) is None:
            return None, None
        mappings = self.spark.read.parquet(f"{self.path}/{version}/mappings")
        return self._cipher(mappings, True), self.spark.read.parquet(f"{self.path}/{version}/counters")

    def encrypted(self) -> bool | None:
        if (version := self.current()) is None:
            return None
        return self._fs().exists(self._at(f"{version}/ENCRYPTED"))

    def write(self, mappings: DataFrame, counters: DataFrame | None = None) -> None:
        """A new version. Without counters they are the largest of the mappings, and of the version before."""
        now = self.current()
        if counters is None:
            counters = mappings.groupBy("scope", "kind").agg(F.max("counter").alias("value"))
            if now is not None:
                counters = counters.unionByName(self.spark.read.parquet(f"{self.path}/{now}/counters")).groupBy("scope", "kind").agg(F.max("value").alias("value"))
        version = f"v-{(int(now.split('-')[1]) if now else 0) + 1:012d}-{uuid.uuid4().hex}"
        self._cipher(mappings, False).write.parquet(f"{self.path}/{version}/mappings")
        counters.write.parquet(f"{self.path}/{version}/counters")
        if self.key is not None:
            self._fs().create(self._at(f"{version}/ENCRYPTED"), False).close()
        self._fs().create(self._at(f"{version}/DONE"), False).close()
        for old in sorted(self.versions())[:-KEEP]:
            remove(self.spark, f"{self.path}/{old}")

    @contextmanager
    def lock(self, wait: float | None = None, stale: float = 3600.0) -> Iterator[None]:
        """Holds the writer's lock; TimeoutError if another does for ``wait`` (the store's) seconds. A lock older than ``stale`` seconds is a dead writer's."""
        fs, at, until = self._fs(), self._at("LOCK"), time.time() + (self.wait if wait is None else wait)
        while True:
            try:
                fs.create(at, False).close()
                break
            except Exception:
                if not fs.exists(at):
                    continue
                if time.time() - fs.getFileStatus(at).getModificationTime() / 1000 > stale:
                    fs.delete(at, False)
                elif time.time() > until:
                    raise TimeoutError("the vault has another writer") from None
                else:
                    time.sleep(0.1)
        try:
            yield
        finally:
            fs.delete(at, False)


def encrypt_in_place(spark: SparkSession, path: str, key: bytes) -> None:
    """A plain vault's tables as an encrypted version, the plain ones removed; ValueError if there is none or it is encrypted."""
    plain = VaultStore(spark, path)
    with plain.lock():
        if (state := plain.encrypted()) is not False:
            raise ValueError("there is no vault" if state is None else "the vault is encrypted already")
        old = plain.versions()
        mappings, counters = plain.read_both()
        VaultStore(spark, path, key).write(mappings, counters)
        for version in old:
            remove(spark, f"{path.rstrip('/')}/{version}")


def create_key(path: str) -> None:
    """32 random bytes as 64 hex digits and a newline in a new file that only its owner reads; FileExistsError if it is there."""
    fd = os.open(path, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600)
    with os.fdopen(fd, "w") as f:
        f.write(secrets.token_hex(32) + "\n")


def read_key(path: str) -> bytes:
    """The key of create_key()'s file; ValueError for any other form, without its content."""
    with open(path) as f:
        text = f.read(66)
    text = text.removesuffix("\n")
    if len(text) != 64 or not set(text) <= set("0123456789abcdefABCDEF"):
        raise ValueError("a key file holds 64 hex digits")
    return bytes.fromhex(text)
