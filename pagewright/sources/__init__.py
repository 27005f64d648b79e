"""Sources and sinks: configuration, PDF facts, page images, model replies, page files and the state log."""
