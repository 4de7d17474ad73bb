"""bitloom: a Spark engine for similarity hashes, their distances and their evaluation."""
