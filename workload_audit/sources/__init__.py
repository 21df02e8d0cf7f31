"""Input tables: schemas, readers and fixture derivations."""
