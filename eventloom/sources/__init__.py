"""Reading topics, messages and payload references; table storage and catalog checks."""
