"""quire — a Spark-native engine for converting, cleaning and profiling tabular data.

Everything is expressed as DataFrame / SQL operations so that the work is planned by
Catalyst and distributed by Spark; only per-file parsing of whole-document formats
(XLSX) runs Python inside tasks.
"""

__version__ = "0.1.0"
