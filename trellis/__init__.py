"""trellis: knowledge-graph / QA data operators as Spark DataFrame jobs.

Every operator is a function ``DataFrame(s) -> DataFrame`` with no action
inside; Catalyst plans the joins, shuffles and pushdowns.
"""

from trellis.session import get_spark, scratch_path  # noqa: F401

__all__ = ["get_spark", "scratch_path"]
