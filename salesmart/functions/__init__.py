"""Column builders shared by the operators. No UDFs."""
