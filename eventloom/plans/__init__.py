"""The operators applied to the driver's tables, each beside its SQL oracle."""
