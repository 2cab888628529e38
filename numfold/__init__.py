"""numfold: numerical analytics as Spark DataFrame operators."""
