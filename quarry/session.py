"""What a session needs before Python code of this library can run on executors."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application.

    Workers of a local master get the source folder on their path; a cluster
    gets the package through Spark's own file server, so that executors need
    neither an install nor a shared source folder.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    if sc.master.startswith("local["):
        sc.environment["PYTHONPATH"] = os.pathsep.join(filter(None, (str(root.parent), sc.environment.get("PYTHONPATH"))))
    else:
        at = os.path.join(tempfile.mkdtemp(dir=sc._temp_dir), f"{root.name}.zip")  # goes with the context
        with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        sc.addPyFile(at)
    _shipped.add(sc.applicationId)


def release_memory() -> None:
    """Give freed memory back to the system: a worker may idle through later stages."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)
