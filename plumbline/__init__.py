"""plumbline: evaluation analytics as PySpark DataFrame jobs.

Question sets, response logs, token-chunk streams and test verdicts go in as
DataFrames; prompts, per-sample scores, run statistics and run comparisons
come out as DataFrames.
"""

from plumbline.session import configure

__all__ = ["configure"]
