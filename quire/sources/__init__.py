"""Where files and tables come from, and where derived tables are kept."""
