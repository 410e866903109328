"""Reading the supplied tables in their roles, transcript/label files, and result tables."""
