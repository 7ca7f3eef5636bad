"""pressroom: news-comment analytics as Spark DataFrame operators.

Sub-packages:

* ``sources``   – scans and sinks (CSV press trees and single CSV tables with an encoding
                  fallback, comment payloads, link extraction, driver parquet tables,
                  first-write-wins sink).
* ``functions`` – reusable Column expressions (null tokens, blank test, time parts,
                  tokenizer, stopwords).
* ``operators`` – the analytic jobs (visibility, profile, time histograms, box statistics,
                  keywords, emotion scores and shares, audit counters, article keys, ...),
                  their building blocks (exact band quantiles, bucketed running sums,
                  size-checked broadcasts) and composed reports.
* ``plans``     – the registered queries that run the operators over the driver tables,
                  with their SQL oracles, and explain / digest / check tools.
* ``streaming`` – incremental ingest with Structured Streaming.
"""

import sys

from pyspark import cloudpickle

# Workers get the package's functions by value, so they need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from pressroom.session import build_session, checkpoint_root, scale_settings  # noqa: E402

__all__ = ["build_session", "checkpoint_root", "scale_settings"]
__version__ = "0.1.0"
