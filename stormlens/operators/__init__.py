"""DataFrame -> DataFrame operators. Every operator takes column names."""
