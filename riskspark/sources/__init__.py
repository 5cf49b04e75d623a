from riskspark.sources.io import (  # noqa: F401
    read_table, read_stage, read_labels, write_table, write_params, read_params, write_report,
)
