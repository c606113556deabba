"""Training-data operators: extraction, scoring, de-duplication, decontamination,
token counts, mixing and sharding.  Nothing else in the library imports this
subpackage."""
