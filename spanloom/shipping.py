"""Sends this package to the executors, whatever folder the driver started in."""

from __future__ import annotations

import os
import tempfile
import zipfile

_SHIPPED: set[str] = set()


def ship(spark, *modules: str) -> None:
    """Add the package (and top-level ``modules``) to the Python path of the executors, once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(here)
    path = os.path.join(tempfile.mkdtemp(prefix="spanloom-code-"), "spanloom.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(here):
            for n in names:
                if not n.endswith(".pyc"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, root))
        for m in modules:
            full = os.path.join(root, f"{m}.py")
            if os.path.exists(full):
                z.write(full, f"{m}.py")
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)
