"""Named queries over a table folder, and their ANSI SQL twins."""
