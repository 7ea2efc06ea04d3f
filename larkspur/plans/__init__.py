"""Every operator as a query, with its SQL."""
