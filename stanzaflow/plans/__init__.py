"""Views over the test tables and repair plans."""
