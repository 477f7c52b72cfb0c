"""Where entries, files and states come from."""
