"""The engine's queries over its tables, each beside its SQL where SQL can say it."""

MODULES = ["core_records", "core_tables", "core_domain", "core_checks"]
