"""Session analytics over decoy-sensor logs, on Spark."""
