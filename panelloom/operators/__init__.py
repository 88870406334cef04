"""DataFrame -> DataFrame operators, generic in entity, period and measures."""
