"""Questions in plain words to checked queries, and the service over the warehouse."""
