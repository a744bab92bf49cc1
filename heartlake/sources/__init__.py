"""Where tables, predictions and signals come from, and where results go."""
