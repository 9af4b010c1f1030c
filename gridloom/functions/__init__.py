"""gridloom.functions."""
