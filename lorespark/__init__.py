"""lorespark: knowledge-archive retrieval and curation as plain Spark jobs.

Pages, tags, links, versioned documents, chunks and job queues are DataFrames;
every operator takes DataFrames and returns a DataFrame.
"""

__version__ = "0.1.0"
