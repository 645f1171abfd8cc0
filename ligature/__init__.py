"""Record linkage as lazy DataFrame plans on Spark."""
