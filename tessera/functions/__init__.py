"""Part of the topic-map engine."""
