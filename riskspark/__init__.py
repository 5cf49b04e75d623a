"""riskspark: tabular risk analytics as Spark DataFrame operators.

Every *fit* is a distributed aggregation that returns a small parameter set;
every *transform* is a plain projection that Catalyst can fuse into one
whole-stage-codegen span.
"""

from riskspark.session import get_spark, checkpoint_dir  # noqa: F401

__all__ = ["get_spark", "checkpoint_dir"]
