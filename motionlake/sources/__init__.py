"""Reading, cleaning and writing athlete files."""
