"""gridloom.plans."""
