"""The query surface: query state and the search engine."""
