"""Sources of documents: generated feeds, JSON files and positional state records, for batch and streaming reads."""
