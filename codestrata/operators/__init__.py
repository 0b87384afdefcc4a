"""DataFrame-to-DataFrame operators, each over many repositories and many questions at once."""
