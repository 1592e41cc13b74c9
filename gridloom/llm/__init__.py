"""Training-data operators over ``documents``-like tables; nothing outside imports this package."""
