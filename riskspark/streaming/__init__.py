"""Streaming apply: fitted parameters applied to a Structured Streaming source.

The reference has no streaming operator (SURVEY 2.11). Every *apply* in this
library is a stateless projection with the fitted parameters inlined as
literals, so the same functions accept ``spark.readStream`` DataFrames
unchanged; this module only wires a source and a sink around them.
"""

from riskspark.streaming.apply import score_stream

__all__ = ["score_stream"]
