"""splitwright: dataset-integrity analytics as Spark DataFrame plans."""
