"""Named queries over the operators, and the SQL each is checked against."""
