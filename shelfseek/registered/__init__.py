"""One runnable query per operator, with the SQL that gives the same rows."""
