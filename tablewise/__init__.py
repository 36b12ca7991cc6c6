"""tablewise: profile, check, query and report on tables of any size with PySpark."""
