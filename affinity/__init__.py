"""Item-affinity analytics on Spark.

Packages used together by applications are scored by exact cosine similarity,
bucketed popularity and download trends, and recommended per dependency list.
Every step is a DataFrame transformation; nothing passes through the driver.
"""

__version__ = "0.1.0"
