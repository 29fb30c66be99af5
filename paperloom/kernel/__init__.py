"""Task-local parsing and writing of one paginated document; no Spark here."""
