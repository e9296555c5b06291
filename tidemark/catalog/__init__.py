"""Rule packs and lookup tables, held as data."""
