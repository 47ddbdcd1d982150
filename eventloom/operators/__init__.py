"""DataFrame operators; every clock read is an ``as_of`` argument."""
