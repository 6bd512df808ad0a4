"""Log files, archives, live feeds, the site registry and CSV output."""
