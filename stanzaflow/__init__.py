"""stanzaflow: curation and recommendation of short literary texts on Spark."""
