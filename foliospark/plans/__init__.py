"""Named queries over the tables, and the SQL they must agree with."""
