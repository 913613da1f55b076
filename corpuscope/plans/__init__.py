"""The declarative query and the named queries made of it."""
