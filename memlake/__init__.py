"""Conversation-memory analytics as PySpark DataFrame jobs."""

import sys

from pyspark import cloudpickle

from memlake.settings import Settings
from memlake.session import build_session, materialize

__all__ = ["Settings", "build_session", "materialize"]

# Small functions of this package that run in Python workers travel with the job,
# so executors do not need the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
