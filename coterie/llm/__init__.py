"""Training-data operators over case narratives, scoring exchanges and captured pages."""
