"""Reading, conforming and writing governance tables and feeds."""
