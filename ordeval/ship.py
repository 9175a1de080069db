"""The package's code for Python workers that can't import it by themselves, such as those of a cluster."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def package_zip(folder: str) -> str:
    """A zip of this package's modules in ``folder``."""
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(folder, f"{os.path.basename(top)}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for where, folders, files in os.walk(top):
            folders[:] = sorted(f for f in folders if f != "__pycache__")
            for name in sorted(files):
                if name.endswith(".py"):
                    full = os.path.join(where, name)
                    z.write(full, os.path.join(os.path.basename(top), os.path.relpath(full, top)))
    return path


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the workers, once for each application; Spark's own file server hands it out, so no folder is
    shared. An installed package needs no shipping, and being sent as well does it no harm."""
    app = spark.sparkContext.applicationId
    if app not in _SENT:
        folder = tempfile.mkdtemp(prefix="ordeval-code-")  # the driver serves it from here as long as the application lives
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.sparkContext.addPyFile(package_zip(folder))
        _SENT.add(app)
    return spark
