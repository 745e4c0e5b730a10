"""DataFrame operators: discovery, extraction, filtering, profiling and assembly of books."""
