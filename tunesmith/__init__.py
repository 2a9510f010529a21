"""tunesmith: model-search and trial-log analytics expressed as Spark DataFrame plans.

Sub-packages
------------
sources    read/write the trial log and the feature tables (Parquet)
functions  Column expressions (normal cdf/pdf, expected improvement, readable formatting, ranks)
operators  DataFrame -> DataFrame operators (prefix scans, trial analytics, search space,
           acquisition, feature preprocessing, surrogate models)
plans      compositions: the leaderboard report, the search loops and the query catalog
streaming  incremental trial-log leaderboard over an appended Parquet log
"""

__version__ = "0.1.0"
