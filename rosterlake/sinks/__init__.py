"""Table maintenance, report tables and exports."""
