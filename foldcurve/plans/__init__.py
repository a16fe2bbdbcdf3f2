"""Model fits, nested evaluation, reports and the registered queries."""
