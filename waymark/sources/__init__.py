"""Sources: file trees, listings, history logs and the extraction cache."""
