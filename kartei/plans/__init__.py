"""Plan helpers: cutting lineage, sized broadcasts, whole queries."""
