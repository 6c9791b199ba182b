"""Models by name: saved ones in a folder that all share, and archives that are downloaded once."""

from __future__ import annotations

import hashlib
import os
import re
import shutil
import tempfile
import time
import urllib.request
import zipfile

from pyspark.sql import SparkSession

from .model import Models

#: Folder of the named models; any path that Spark can read. Of downloaded ones: a local or mounted folder.
REGISTRY = os.environ.get("LINEWEAVE_MODELS", "")
WAIT_S, STALE_S = 600, 900


def _place(name: str, registry: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", name):
        raise ValueError(f"{name!r} is no name for a model")
    if not registry:
        raise ValueError("no folder of models is named")
    return f"{registry.rstrip('/')}/{name}"


def publish(models: Models, name: str, registry: str = REGISTRY) -> str:
    """Save models under a name; fails if the name is taken."""
    path = _place(name, registry)
    models.save(path)
    return path


def _exists(path: str) -> bool:
    spark = SparkSession.getActiveSession()
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def fetched(url: str, cache: str, sha256: str | None = None) -> str:
    """The folder of a zipped model, downloaded once: of several processes one loads it, the others wait for it.

    The archive goes to a folder of its own, which gets its last name when it is whole; a lock older than STALE_S is that
    of a process that died. A wrong digest, or a member that would leave the folder: ValueError, and nothing is kept.
    """
    path = os.path.join(cache, hashlib.sha256(url.encode()).hexdigest()[:32])
    lock, began = f"{path}.lock", time.monotonic()
    os.makedirs(cache, exist_ok=True)
    while not os.path.isdir(path):
        try:
            os.close(os.open(lock, os.O_CREAT | os.O_EXCL))
        except FileExistsError:
            try:
                if time.time() - os.path.getmtime(lock) > STALE_S:
                    os.unlink(lock)
            except FileNotFoundError:
                continue
            if time.monotonic() - began > WAIT_S:
                raise TimeoutError(f"{lock} is held") from None
            time.sleep(0.1)
            continue
        own = tempfile.mkdtemp(dir=cache)
        try:
            archive = os.path.join(own, "archive")
            with urllib.request.urlopen(url, timeout=60) as source, open(archive, "wb") as target:
                shutil.copyfileobj(source, target)
            with open(archive, "rb") as f:
                found = hashlib.file_digest(f, "sha256").hexdigest()
            if sha256 is not None and found != sha256:
                raise ValueError(f"{url} has the digest {found}")
            whole = os.path.join(own, "model")
            with zipfile.ZipFile(archive) as z:
                for member in z.namelist():
                    if not os.path.realpath(os.path.join(whole, member)).startswith(os.path.realpath(whole) + os.sep):
                        raise ValueError(f"{member!r} would leave the folder")
                z.extractall(whole)
            if not os.path.isdir(path):
                os.rename(whole, path)
        finally:
            shutil.rmtree(own, ignore_errors=True)
            os.unlink(lock)
    return path


def load(name: str, registry: str = REGISTRY, cache: str | None = None) -> Models:
    """Models by the path of a folder, by a name in the registry, or by the address of a zipped folder."""
    if re.match(r"https?://", name):
        return Models.load(f"file://{fetched(name, os.path.abspath(cache or os.path.join(os.path.expanduser('~'), '.cache', 'lineweave')))}")
    if registry and re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", name) and _exists(_place(name, registry)):
        return Models.load(_place(name, registry))
    return Models.load(name)
