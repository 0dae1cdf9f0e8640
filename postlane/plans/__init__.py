"""The registered queries of the package and their SQL."""
