"""Reading and standardizing documents and web pages."""
