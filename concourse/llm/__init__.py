"""Training-data operators: whole texts in, Spark tables out.  Nothing else in the library imports this package."""
