"""Literature evidence on Spark: compound-target-disease triplets and what is known about them."""
