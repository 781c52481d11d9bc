"""Reading and writing: CSV, text and JSON at the edges, Parquet between jobs."""
