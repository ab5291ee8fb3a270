"""Sources, incremental picks, sinks and the model-call stage."""
