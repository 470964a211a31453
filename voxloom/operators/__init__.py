"""``DataFrame -> DataFrame`` operators, for use with ``DataFrame.transform``."""
