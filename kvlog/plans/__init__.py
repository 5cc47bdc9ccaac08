"""Plans over change logs: versions, snapshots, run catalogs."""
