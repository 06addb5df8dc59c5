"""Column functions over symbols, alignments and scores."""
