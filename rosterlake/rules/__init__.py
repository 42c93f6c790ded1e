"""Fixed values shared by the operators.  No Spark code lives here."""
