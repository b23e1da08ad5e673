"""Column functions: text cleaning, chat rendering, ROUGE, array padding."""
