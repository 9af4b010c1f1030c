"""gridloom.sources."""
