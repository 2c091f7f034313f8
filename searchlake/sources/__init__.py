"""Where records and dictionaries come from, and where collections are kept."""
