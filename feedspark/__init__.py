"""feedspark: feed collection, article queues, page extraction, bill enrichment
and extractive sentence ranking, written as Spark DataFrame and Structured
Streaming jobs.

Sub-packages:

- ``functions``  Column expressions (text, dates, HTML) and the few Arrow UDFs.
- ``sources``    readers and sinks (feeds, tracker, articles, pages, outbox).
- ``operators``  the jobs' building blocks over whole DataFrames.
- ``plans``      end-to-end batch jobs, test fixtures, the query registry.
- ``streaming``  incremental collection with Structured Streaming.
"""

__version__ = "0.1.0"
