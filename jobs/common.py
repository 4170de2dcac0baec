"""What the jobs share: settings, logging, sessions of the command line, folders for the registered queries."""

from __future__ import annotations

import json
import logging
import tempfile
from pathlib import Path
from uuid import uuid4

from pyspark.sql import SparkSession


def settings(job: str, path: str | None = None) -> dict:
    """The job's own JSON file, overridden by one that is given; a name the first doesn't have is an error."""
    out = json.loads(Path(job).with_suffix(".json").read_text())
    given = json.loads(Path(path).read_text()) if path else {}
    if unknown := given.keys() - out.keys():
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    return out | given


def logger(name: str) -> logging.Logger:
    logging.basicConfig(level=logging.WARNING, format="%(asctime)s %(name)s %(message)s")
    log = logging.getLogger(f"helixframe.jobs.{name}")
    log.setLevel(logging.INFO)
    return log


def session(name: str) -> SparkSession:
    """A session of the command line's own; everything else is the launcher's to set."""
    return SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder no other call has, in the one that the cluster shares; a local one only where spark.checkpoint.dir is unset in local mode."""
    if not (shared := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="helixframe-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared}/{name}-{uuid4().hex}"
