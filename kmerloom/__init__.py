"""kmerloom: word-similarity analytics over sequences, expressed as Spark DataFrame plans."""
