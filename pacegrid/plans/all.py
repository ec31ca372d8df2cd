from pacegrid.plans import access, classes, details, edits, networks, parks, pricing, progress, rasters, scalars, sequences, spatial, stores, streams, walks  # noqa: F401
