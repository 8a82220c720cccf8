"""The registered queries, the views they read, and the SQL each one is checked against."""
