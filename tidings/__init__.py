"""Event-report analytics on PySpark: sources, functions, operators, plans and streams."""
