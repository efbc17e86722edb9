"""The registered queries, the views they run on, and the SQL they are checked against."""
