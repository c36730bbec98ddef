"""Bindings of the operators to the driver's tables, with the SQL that says the same."""
