"""folio: a PySpark-native analytics engine for document corpora and their metadata."""
