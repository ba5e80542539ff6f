"""Evidence-grounded document analytics as Spark plans."""
