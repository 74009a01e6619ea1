"""Study-corpus analytics as Spark DataFrame plans."""
