"""pointlake: multi-dimensional point and indexed-array analytics as Spark plans."""
