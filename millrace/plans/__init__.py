"""Named workload queries, each with the SQL that gives the same answer."""
