"""Sessions that chain the operators, and the registered queries."""
