"""quarrymill: a hybrid-search analytics engine on PySpark."""
