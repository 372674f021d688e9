"""Sources and sinks: file trees, side files, gazetteers, images and their metadata."""
