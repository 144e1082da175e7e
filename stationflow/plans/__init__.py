"""Views on the test tables and the registered queries."""
