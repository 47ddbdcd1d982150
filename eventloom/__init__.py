"""Spark-native event synchronisation, normalisation and detection library.

Sub-packages:

* ``functions``  - column helpers (JSON fields, hashing, timestamps, text, error classes)
* ``sources``    - topics, messages, payload references, snapshot tables, catalog checks
* ``operators``  - normalisers, keyed merges, ledger steps, detection, roll-ups, dead letters
* ``streaming``  - Structured Streaming wiring of the same operators
* ``plans``      - the operators applied to the driver's tables, with their SQL oracles

All timestamps are ``TIMESTAMP_NTZ`` holding UTC, so no result depends on the
session time zone.  Every clock read is an explicit ``as_of`` argument.
"""
