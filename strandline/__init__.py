"""strandline: session, archive and retrieval analytics written for Spark."""
