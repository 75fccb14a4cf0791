"""veilspark: personal-data protection over text, and training-data preparation, as Spark DataFrame transformations."""
