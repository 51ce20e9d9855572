"""Operators for large-scale training-data preparation. Nothing else in the library imports this."""

import os

# Spark runs one Python worker a core: a BLAS with threads of its own only gets in the way.
os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")
