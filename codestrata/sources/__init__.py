"""Reading corpora and catalogues, writing tables and event files."""
