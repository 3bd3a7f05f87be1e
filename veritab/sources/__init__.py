"""Sources and sinks: text tables, tag-length files, specification texts, run stores."""
