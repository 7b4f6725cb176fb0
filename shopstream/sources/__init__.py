"""Sources and sinks: driver tables, the canonical adapters, JSON/Kafka I/O."""
