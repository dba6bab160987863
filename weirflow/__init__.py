"""weirflow: trusted sensor tables and fleet analytics as Spark DataFrame operators."""
