"""vellumine: document analytics on PySpark DataFrames."""

import os

# Spark's tasks have the cores; linear algebra threads beside them would only wait for each other.
os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")
