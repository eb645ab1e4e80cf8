"""Queue, group commit and the background indexer."""
