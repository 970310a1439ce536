"""zenithal: space-domain catalog, conjunction, graph, text and provenance operators as Spark DataFrame functions."""
