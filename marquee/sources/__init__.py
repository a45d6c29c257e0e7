"""Reading and writing the tables, text files and stores."""
