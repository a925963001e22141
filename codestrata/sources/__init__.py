"""Sources and sinks: directories, Git commits and histories, reports and ledgers."""
