"""waymark: text-position analytics and corpus preparation as Spark plans."""
