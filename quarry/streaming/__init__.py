"""Message streams: parsing, count windows and incremental indexing."""
