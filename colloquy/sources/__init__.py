"""Readers and writers: episodes, captions, pages and index artifacts."""
