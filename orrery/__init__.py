"""Evidence-to-concept ranking and corpus analytics as Spark plans."""
