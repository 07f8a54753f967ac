"""Sinks: reports, appended rows, versioned snapshots."""
