"""skein: an entity- and document-intelligence engine planned entirely on Spark."""
