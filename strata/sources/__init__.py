"""Storage: shared folders, the manifest, runs and native-format readers."""
