"""sigloom: a PySpark engine that compiles a feature protocol into DataFrame plans."""
