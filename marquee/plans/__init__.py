"""How big plans stay balanced: heavy keys, ordered numbering, cut lineage."""
