"""Training-data operators. ``catalog`` lists their queries and SQL; nothing outside this package imports it."""
