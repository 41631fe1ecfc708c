"""DataFrame-to-DataFrame operators on tracks, trips and their neighbours."""
