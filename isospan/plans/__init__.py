"""The query catalogue over the star-schema tables, and SQL that gives the same rows."""
