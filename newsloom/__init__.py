"""newsloom: DataFrame operators for a news-and-telemetry data platform on PySpark.

Every operator is a ``DataFrame -> DataFrame`` function (``df.transform`` style) built
from Spark SQL built-ins, so Catalyst can push filters and projections into the scans
and Tungsten keeps the work inside whole-stage codegen.
"""

from newsloom.session import ensure_session_defaults, get_session, scratch_path

__all__ = ["ensure_session_defaults", "get_session", "scratch_path"]
