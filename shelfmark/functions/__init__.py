"""Column builders; see the modules for the groups they form."""
