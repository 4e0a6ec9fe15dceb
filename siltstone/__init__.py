"""siltstone: quality, duplication and provenance queries over text corpora, as Spark DataFrames."""
