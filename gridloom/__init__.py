"""gridloom: chunked n-dimensional arrays as Spark relations."""
