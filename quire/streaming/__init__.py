"""The same rules over streams of pages and events."""
