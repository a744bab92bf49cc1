"""Column functions: built-in expressions only, no Python at run time."""
