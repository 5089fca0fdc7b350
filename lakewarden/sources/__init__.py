"""Sources and sinks: CSV and document folders, dictionary, ground truth, reports, chunk index."""
