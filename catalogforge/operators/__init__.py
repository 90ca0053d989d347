"""DataFrame operators. They take column names where any table will do."""
