"""Structured Streaming: correction events and odometry gates."""
