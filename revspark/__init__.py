"""revspark: code-review findings analytics on Spark.

Tables of source files, scanner reports, pull-request records and stored model
responses go in; normalised findings, rankings, counts, scores and review
payloads come out.  Every operator is a ``DataFrame -> DataFrame`` function.
"""

__version__ = "0.1.0"
