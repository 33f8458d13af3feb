"""Features, regional models, comparison and scoring."""
