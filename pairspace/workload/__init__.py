"""The registered queries: operators bound to the given tables, each with the
SQL that has to give the same rows."""
