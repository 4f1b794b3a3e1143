"""Every operator and analysis as a query over the test tables, next to its check in SQL."""
