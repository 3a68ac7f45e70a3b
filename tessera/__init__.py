"""Cell search over spreadsheets, delimited files and Spark tables, as DataFrame plans."""
