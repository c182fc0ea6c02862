"""Reading and writing feeds and tables."""
