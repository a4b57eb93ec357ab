"""Reading and writing corpora, stored files, tables and the search log."""
