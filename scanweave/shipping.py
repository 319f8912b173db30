"""Send the package to the Python workers of a session that was started without it.

A cluster job passes the package with --py-files; a notebook or a test that only has it on
its own path calls ``ship`` once.  It also sets what the package needs of the session.
"""

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_PACKAGE = os.path.dirname(os.path.abspath(__file__))
_shipped = set()


def ship(spark: SparkSession) -> None:
    # Spark 4.1 takes the union of two tables spread by one key for a table spread by it, but may
    # string the partitions together where shuffles are reused; a group would then come apart.
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="scanweave-"), "scanweave_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(_PACKAGE):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(_PACKAGE)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)
