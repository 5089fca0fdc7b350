"""Checks at ingestion: the batch operators on every new batch of a file stream."""
