"""stepweave: reasoning-supervision curation, scoring and evaluation as Spark DataFrame plans."""
