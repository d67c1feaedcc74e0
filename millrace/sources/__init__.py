"""Sources, decoders and sinks."""
