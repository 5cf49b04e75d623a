"""Import every query module so that the registry is complete."""

from riskspark.plans import (q_evaluate, q_features, q_invariants, q_io, q_missing, q_models, q_outlier,  # noqa: F401
                             q_profile, q_reduce, q_schema)
