"""Where runs are written: local files and tables in a shared folder."""
