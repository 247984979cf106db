"""The test tables seen as access rights, and the registered queries with their SQL."""
