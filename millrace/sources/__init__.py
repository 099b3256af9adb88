"""Reading files of mixed encodings and columns; writing tables, reports, models."""
