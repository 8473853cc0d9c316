"""Row and column lineage, fault tracing and input minimization for PySpark DataFrame jobs."""

from rowtrail.operators import aggregates, influence
from rowtrail.operators.frame import TracedFrame
from rowtrail.operators.trace import Trace
from rowtrail.sources.registry import Source, TraceContext

__all__ = ["TraceContext", "TracedFrame", "Trace", "Source", "aggregates", "influence"]
