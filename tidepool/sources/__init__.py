"""Sources and sinks: tables, archives, pasted text and vendor exports."""
