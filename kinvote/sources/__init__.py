"""Table readers, artifact readers and the shared scratch store."""
