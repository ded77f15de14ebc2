from truthloom.sources.files import (
    read_claims, read_truth, write_claims, write_partition_report, write_truth,
)
from truthloom.sources.generate import (
    assign_sources, generate_claims, generate_truth, split_properties,
)

__all__ = [
    "read_claims", "read_truth", "write_claims", "write_truth", "write_partition_report",
    "generate_truth", "generate_claims", "split_properties", "assign_sources",
]
