"""File-log analytics on Spark: catalogs, search, lines, archives, change streams."""
