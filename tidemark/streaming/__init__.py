"""Streaming forms of the event clean-up, the regime report and the feature flag."""
