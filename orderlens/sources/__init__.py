"""Tables: adapters from the star-schema tables, hot and cold storage, sinks."""
