"""Reading, describing and registering source files."""
