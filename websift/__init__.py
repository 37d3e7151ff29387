"""websift: collect web pages, index them and answer tables of search queries, on PySpark."""
