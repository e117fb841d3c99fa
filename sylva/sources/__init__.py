"""Where trees come from and where they go: file systems and manifest files."""
