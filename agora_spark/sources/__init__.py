"""Table readers, the event lake, and stand-in tables over the star schema."""
