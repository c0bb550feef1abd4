"""Tree documents and training corpora on Spark."""
