"""Session settings the jobs rely on, and the shared working folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # JSON objects with a repeated key are legal input; the last value wins.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Pre-merge session windows per task, so that a request with very many
    # chunks is shrunk before the shuffle.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


# Applications whose executors have been given this package.
_SHIPPED: set[str] = set()


def configure(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings to ``spark``, ship the package, return ``spark``."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once per application.

    Functions that run in Python workers are found there by name. Spark hands
    the archive out from the driver, so the folder it is made in is nobody
    else's concern.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="plumbline-"), "plumbline.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(top)))
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder of the cluster.

    The folder comes from ``spark.checkpoint.dir``. Only a session within one
    process (a unit test) may lack that setting and then gets a local folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir has to name a folder that all of {master} share")
        base = tempfile.mkdtemp(prefix="plumbline-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
