"""Sources and sinks: the action log, bookshelf JSON and HTML, run
parameters, the text run log, and adapters over the driver's test tables."""
