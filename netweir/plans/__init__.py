"""Planning helpers: size checks, scratch space, rollup definitions, filters."""
