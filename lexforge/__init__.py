"""lexforge: analytics and retrieval over versioned document corpora, on PySpark."""
