"""Table readers, text and JSON sinks, injectable remote sources."""
